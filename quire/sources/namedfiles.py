"""A sink that writes each row as a file of its own name, all or none.

Tasks write under ``_temporary/<job>/<task>``; when all have ended, the driver moves what the tasks that count
have reported into place, and when the job fails it removes the job's folder. A task that dies, or runs twice,
leaves nothing where results are read. Moves are one metadata call a file, by a pool of threads.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .tensorfiles import opened


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


def checked(name: str | None) -> str:
    """A relative path that stays inside the sink."""
    parts = (name or "").split("/")
    if any(p in ("", ".", "..") for p in parts) or parts[0] == "_temporary":
        raise ValueError(f"not a file name: {name!r}")
    return "/".join(parts)


class NamedFilesWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.root, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        system, root = opened(self.root)
        context = TaskContext.get()
        folder = f"_temporary/{self.job}/{context.partitionId()}-{context.taskAttemptId()}"
        names = []
        for row in rows:
            name = checked(row["name"])
            target = f"{root}/{folder}/{name}"
            system.create_dir(target.rsplit("/", 1)[0], recursive=True)
            content = row["content"]
            with system.open_output_stream(target) as out:
                out.write(b"" if content is None else content.encode() if isinstance(content, str) else bytes(content))
            names.append(name)
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = opened(self.root)
        files = [(m.folder, n) for m in messages if m for n in m.names]
        names = [n for _, n in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two rows have the same name")
        if self.overwrite and system.get_file_info(root).type == fs.FileType.Directory:
            for old in system.get_file_info(fs.FileSelector(root)):
                for stale in system.get_file_info(fs.FileSelector(old.path)) if old.base_name == "_temporary" else ():
                    if stale.base_name != self.job:
                        system.delete_dir(stale.path)
                if old.base_name != "_temporary":
                    system.delete_dir(old.path) if old.type == fs.FileType.Directory else system.delete_file(old.path)
        for folder in sorted({n.rsplit("/", 1)[0] for n in names if "/" in n}):
            system.create_dir(f"{root}/{folder}", recursive=True)
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda x: system.move(f"{root}/{x[0]}/{x[1]}", f"{root}/{x[1]}"), files))
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """Removes what the job has written aside. Tasks that are being killed may still add to it; the next overwriting job sweeps that."""
        system, root = opened(self.root)
        if system.get_file_info(f"{root}/_temporary/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/_temporary/{self.job}")
        if system.get_file_info(f"{root}/_temporary").type == fs.FileType.Directory and not system.get_file_info(fs.FileSelector(f"{root}/_temporary")):
            system.delete_dir(f"{root}/_temporary")


class NamedFiles(DataSource):
    """``df.write.format("named_files").save(path)`` of rows (name string, content string or binary)."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema, overwrite: bool) -> NamedFilesWriter:
        return NamedFilesWriter(self.options["path"], overwrite)


def write_named(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Writes (name, content) as files under ``path``; ``append`` leaves other files alone and replaces those of the same name."""
    rows.sparkSession.dataSource.register(NamedFiles)
    rows.select("name", "content").write.format("named_files").mode(mode).save(path)


def document_files(docs: DataFrame, name: str, **contents: str) -> DataFrame:
    """(name, content): for each document ``name/name.suffix`` of each column; suffix=column, nulls have no file."""
    stem = F.regexp_replace(F.col(name).cast("string"), r"[/\\\x00]", "_")
    each: list[Column] = [F.struct(F.concat(stem, F.lit("/"), stem, F.lit(f".{suffix}")).alias("name"), F.col(c).cast("string").alias("content")) for suffix, c in contents.items()]
    return docs.select(F.inline(F.array(*each))).where("content is not null")
