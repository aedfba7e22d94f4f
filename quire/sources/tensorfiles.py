"""Tensor files read by ranges: the header alone for an inventory, and of the values only what is asked for.

A file is 8 bytes of little-endian length, a JSON header of that length, then the values at the offsets that
the header gives. Each file is a partition; its bytes beyond the ranges are never read, so files may be of
any size. Any file system that pyarrow opens will do (local, s3, gs, hdfs).
"""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed value: the longest header, in bytes.
MAX_HEADER = 32 << 20
#: Names of value types; bfloat16 is widened by hand.
TYPES = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "BF16": "<u2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "i1", "U8": "u1", "BOOL": "u1"}
SCHEMA = "path string, name string, dtype string, shape array<bigint>, begin bigint, end bigint"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def header(stream, path: str) -> tuple[dict, int]:
    """The tensors of an open file by name, and where its values begin."""
    raw = stream.read(8)
    if len(raw) < 8:
        raise ValueError(f"{path}: missing header length")
    size = int.from_bytes(raw, "little")
    if not 0 < size <= MAX_HEADER:
        raise ValueError(f"{path}: invalid header length {size}")
    text = stream.read(size)
    if len(text) < size:
        raise ValueError(f"{path}: truncated header")
    try:
        found = json.loads(text)
    except ValueError as e:
        raise ValueError(f"{path}: the header isn't JSON") from e
    if not isinstance(found, dict):
        raise ValueError(f"{path}: the header isn't an object")
    good = lambda t: isinstance(t, dict) and isinstance(t.get("dtype"), str) and isinstance(t.get("shape"), list)
    return {k: t for k, t in found.items() if k != "__metadata__" and good(t)}, 8 + size


def decoded(raw: bytes, dtype: str) -> np.ndarray:
    """Values as single-precision floats."""
    x = np.frombuffer(raw, TYPES[dtype])
    return (x.astype(np.uint32) << 16).view(np.float32) if dtype == "BF16" else x.astype(np.float32)


@dataclass
class OneFile(InputPartition):
    path: str


class TensorReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.glob = options["path"], options.get("glob", "*.safetensors")
        self.names = json.loads(options["names"]) if "names" in options else None

    def partitions(self) -> list[OneFile]:
        system, path = opened(self.root)
        found = system.get_file_info(fs.FileSelector(path, recursive=True)) if system.get_file_info(path).type == fs.FileType.Directory else [system.get_file_info(path)]
        prefix = self.root[: len(self.root) - len(path)] if self.root.endswith(path) else ""
        return [OneFile(prefix + x.path) for x in sorted(found, key=lambda x: x.path) if x.is_file and fnmatch.fnmatch(x.base_name, self.glob)]

    def read(self, partition: OneFile) -> Iterator[pa.RecordBatch]:
        system, path = opened(partition.path)
        with system.open_input_file(path) as stream:
            tensors, start = header(stream, partition.path)
            for name in sorted(tensors):
                if self.names is not None and name not in self.names:
                    continue
                t = tensors[name]
                begin, end = t.get("data_offsets") or (None, None)
                columns = [[partition.path], [name], [t["dtype"]], [[int(d) for d in t["shape"]]], [begin], [end]]
                kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int64()]
                fields = ["path", "name", "dtype", "shape", "begin", "end"]
                if self.names is not None:
                    stream.seek(start + begin)
                    columns, kinds, fields = [*columns, [decoded(stream.read(end - begin), t["dtype"])]], [*kinds, pa.list_(pa.float32())], [*fields, "values"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], fields)


class TensorFiles(DataSource):
    """``spark.read.format("tensor_files")``: a row a tensor; option ``names`` (a JSON list) reads the values of these alone."""

    @classmethod
    def name(cls) -> str:
        return "tensor_files"

    def schema(self) -> str:
        return SCHEMA + ", values array<float>" * ("names" in self.options)

    def reader(self, schema) -> TensorReader:
        return TensorReader(dict(self.options))


def tensor_inventory(spark: SparkSession, path: str, glob: str = "*.safetensors", unique: bool = True) -> DataFrame:
    """(path, name, dtype, shape, begin, end) of all tensors under a folder, from the headers alone; a name in two files is an error if ``unique``."""
    spark.dataSource.register(TensorFiles)
    rows = spark.read.format("tensor_files").option("glob", glob).load(path)
    if not unique:
        return rows
    twice = rows.groupBy("name").agg(F.count("*").alias("_n"), F.sort_array(F.collect_list("path")).alias("_in"))
    problem = F.raise_error(F.concat(F.lit("tensor "), F.col("name"), F.lit(" is in "), F.array_join("_in", " and "))).cast("int")
    return rows.join(twice.select("name", F.when(F.col("_n") > 1, problem).otherwise(1).alias("_ok")), "name").where("_ok = 1").select("path", "name", "dtype", "shape", "begin", "end")


def read_tensors(spark: SparkSession, path: str, names: list[str], glob: str = "*.safetensors") -> DataFrame:
    """The same rows for the tensors named, with their ``values`` as single-precision floats, flat; only these ranges are read."""
    spark.dataSource.register(TensorFiles)
    return spark.read.format("tensor_files").option("glob", glob).option("names", json.dumps(names)).load(path)
