"""Ranged reads of tensor files, files by name with commit and abort, configurations, page trees, probes."""

import json
import os
import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.sources import namedfiles as N
from quire.sources import tensorfiles as T


def tensor_file(path, tensors, grow=0):
    """A file of {name: (dtype, array of bytes, shape)}; ``grow`` is its size in the end."""
    head, at, body = {"__metadata__": {"dtype": "x"}, "odd": 3}, 0, b""
    for name, (dtype, raw, shape) in tensors.items():
        head[name] = {"dtype": dtype, "shape": shape, "data_offsets": [at, at + len(raw)]}
        at, body = at + len(raw), body + raw
    text = json.dumps(head).encode()
    with open(path, "wb") as f:
        f.write(struct.pack("<Q", len(text)) + text + body)
        if grow:
            f.truncate(grow)


def test_headers_of_huge_files(spark, tmp_path):
    x = np.arange(6, dtype=np.float32)
    tensor_file(tmp_path / "a.safetensors", {"a.w": ("F32", x.tobytes(), [2, 3])}, grow=3 << 30)  # sparse
    half = (np.array([1.5, -2.0], np.float32).view(np.uint32) >> 16).astype(np.uint16)
    (tmp_path / "sub").mkdir()
    tensor_file(tmp_path / "sub" / "b.safetensors", {"b.w": ("BF16", half.tobytes(), [2]), "c": ("I64", np.array([7]).tobytes(), []), "d": ("F16", np.array([0.5], np.float16).tobytes(), [1])})
    (tmp_path / "notes.txt").write_text("no tensor file")
    began = time.time()
    got = T.tensor_inventory(spark, str(tmp_path)).orderBy("name")
    assert [(r.name, r.dtype, r.shape, r.begin, r.end) for r in got.collect()] == [("a.w", "F32", [2, 3], 0, 24), ("b.w", "BF16", [2], 0, 4), ("c", "I64", [], 4, 12), ("d", "F16", [1], 12, 14)]
    assert time.time() - began < 60
    values = T.read_tensors(spark, f"file://{tmp_path}", ["a.w", "b.w", "c", "d"])
    assert {r.name: r["values"] for r in values.collect()} == {"a.w": [0.0, 1.0, 2.0, 3.0, 4.0, 5.0], "b.w": [1.5, -2.0], "c": [7.0], "d": [0.5]}
    assert values.rdd.getNumPartitions() == 2


def test_bad_tensor_files(spark, tmp_path):
    one = {"a": ("F32", b"\0" * 4, [1])}
    for folder in ("twice", "short", "long", "cut", "text", "list"):
        (tmp_path / folder).mkdir()
    for name in ("1.safetensors", "2.safetensors"):
        tensor_file(tmp_path / "twice" / name, one)
    (tmp_path / "short" / "x.safetensors").write_bytes(b"123")
    (tmp_path / "long" / "x.safetensors").write_bytes(struct.pack("<Q", 1 << 40))
    (tmp_path / "cut" / "x.safetensors").write_bytes(struct.pack("<Q", 100) + b"{}")
    (tmp_path / "text" / "x.safetensors").write_bytes(struct.pack("<Q", 3) + b"abc")
    (tmp_path / "list" / "x.safetensors").write_bytes(struct.pack("<Q", 2) + b"[]")
    for folder, message in {"twice": "tensor a is in .*1.safetensors and .*2.safetensors", "short": "missing header length", "long": "invalid header length", "cut": "truncated header", "text": "isn't JSON", "list": "isn't an object"}.items():
        with pytest.raises(Exception, match=message):
            T.tensor_inventory(spark, str(tmp_path / folder)).collect()
    assert T.tensor_inventory(spark, str(tmp_path / "twice"), unique=False).count() == 2


def tree(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), encoding="utf-8").read() for d, _, names in os.walk(root) for f in names}


def test_named_files(spark, tmp_path):
    root = str(tmp_path / "out")
    docs = spark.createDataFrame([("a", "# A", "[]"), ("b/c", "é\n", None), ("d", "", "{}")], "name string, markdown string, blocks string").repartition(3)
    files = N.document_files(docs, "name", md="markdown", json="blocks")
    N.write_named(files, root)
    want = {"a/a.md": "# A", "a/a.json": "[]", "b_c/b_c.md": "é\n", "d/d.md": "", "d/d.json": "{}"}
    assert tree(root) == want
    assert not os.path.exists(f"{root}/_temporary")
    N.write_named(files.where("name = 'a/a.md'").withColumn("content", F.lit("new")), root, "append")
    assert tree(root) == want | {"a/a.md": "new"}
    N.write_named(files.where("name like 'd/%'"), root)
    assert tree(root) == {"d/d.md": "", "d/d.json": "{}"}


def test_named_files_all_or_none(spark, tmp_path):
    root = str(tmp_path / "out")
    N.write_named(spark.createDataFrame([("old", "x")], "name string, content string"), root)
    rows = spark.range(40).repartition(4).select(F.concat(F.lit("n"), "id").alias("name"), F.when(F.col("id") == 33, F.raise_error(F.lit("broken row")).cast("string")).otherwise("x").alias("content"))
    bad = [(rows, "broken row"), (spark.createDataFrame([("a", "x"), ("../b", "y")], "name string, content string"), "not a file name"), (spark.createDataFrame([("a", "x"), ("a", "y")], "name string, content string").repartition(2), "same name")]
    for frame, message in bad:
        with pytest.raises(Exception, match=message):
            N.write_named(frame, root)
        assert {k for k in tree(root) if not k.startswith("_temporary/")} == {"old"}
    N.write_named(spark.createDataFrame([], "name string, content string"), root, "append")
    assert tree(root)["old"] == "x"
    os.makedirs(f"{root}/_temporary/dead/0-1", exist_ok=True)  # of a driver that died
    N.write_named(spark.createDataFrame([("new", "y")], "name string, content string"), root)
    assert tree(root) == {"new": "y"}
    assert not os.path.exists(f"{root}/_temporary")


def config(spark, text, schema):
    from quire.functions import config as C

    return spark.createDataFrame([(text,)], "t string").select(C.read_config(F.col("t"), schema).alias("c")).first().c


def test_configurations(spark):
    from quire.functions import config as C

    got = config(spark, '{"model_type": "x", "text_config": {"hidden_size": 1536, "rope_parameters": {"rope_theta": 10000}}, "vision_config": {"image_size": 336}, "image_token_id": 5, "unknown": {}}', C.RECOGNISER)
    assert got.problem is None
    assert (got.config.text_config.hidden_size, got.config.text_config.rope_parameters.rope_theta, got.config.vision_config.image_size, got.config.image_token_id, got.config.video_token_id) == (1536, 10000.0, 336, 5, None)
    plain = config(spark, '{"size": null, "do_resize": null}', C.PREPROCESSOR).config
    assert (plain.do_resize, plain.image_mean, plain.size.height) == (True, [0.5, 0.5, 0.5], None)
    faults = {
        '{"do_resize": "yes"}': "bad field do_resize",
        '{"size": {"height": 3.5}}': "bad field size.height",
        '{"size": [1]}': "bad field size",
        '{"image_mean": ["a"]}': "bad field image_mean",
        '{"image_std": 0.5}': "bad field image_std",
        '{"rescale_factor": {}, "resample": "x"}': "bad field rescale_factor",
        "[]": "not a JSON object",
        "{": "not a JSON object",
    }
    for text, problem in faults.items():
        got = config(spark, text, C.PREPROCESSOR)
        assert (got.config, got.problem) == (None, problem)
    assert config(spark, None, C.PREPROCESSOR).problem == "not a JSON object"


def test_class_labels(spark):
    from quire.functions import config as C

    rows = [('{"id2label": {"0": "abstract", "14": "image"}}',), ('{"id2label": {"0": "a", "x1": "b"}}',), ("{}",), ('{"id2label": {"1.0": "a"}}',)]
    t = spark.createDataFrame(rows, "t string").select(C.class_labels(C.read_config(F.col("t"), C.LAYOUT)["config"]["id2label"]).alias("c"))
    assert [(r.c.labels, r.c.problem) for r in t.collect()] == [({0: "abstract", 14: "image"}, None), (None, "invalid id2label key: x1"), (None, "missing id2label"), (None, "invalid id2label key: 1.0")]


def test_probe(spark):
    from quire.operators.probe import Probe

    probe = Probe()
    t = spark.createDataFrame([(1, [1.0, 2.0]), (2, [5.0, None, -3.0]), (3, None)], "id int, v array<double>")
    t = probe.watch(t, "vectors", "v", {"second": ("id = 2", 2), "none": ("id = 9", 0)})
    n = probe.watch(t.select("id", F.size("v").alias("n")), "sizes", "n")
    n.write.format("noop").mode("overwrite").save()
    got = probe.captures()
    assert got["vectors"] == {"rows": 3, "values": 4, "min": -3.0, "max": 5.0, "longest": 3, "mean": 1.25, "dtype": "array<double>", "samples": {"second": -3.0, "none": None}}
    assert (got["sizes"]["rows"], got["sizes"]["max"]) == (3, 3.0)
    with pytest.raises(ValueError, match="watched already"):
        probe.watch(t, "sizes", "id")
