"""Files as DataFrames: corpora, images' bytes, JSON, tensor inventories, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The suffixes that are inputs, and files that never are.
SUFFIXES = ["jpeg", "jpg", "pdf", "png"]
NOISE = r"(?:^|/)(?:\.DS_Store|Thumbs\.db|\._[^/]*)$"
# The tensors that a layout model must have; the first is the stem, over three channels.
REQUIRED = [
    "model.backbone.model.embedder.stem1.convolution.weight",
    "model.encoder.downsample_convs.0.conv.weight",
    "model.encoder.encoder.0.layers.0.self_attn.q_proj.weight",
    "model.decoder.layers.0.self_attn.q_proj.weight",
    "model.decoder.layers.0.encoder_attn.value_proj.weight",
    "model.enc_score_head.weight",
    "model.enc_bbox_head.layers.0.weight",
]
# Fixed value: the longest header of a tensor file, in bytes.
MAX_HEADER = 32 << 20


def binary_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, modificationTime, length, content); undecoded, as no image library is assumed."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def list_examples(paths: DataFrame) -> DataFrame:
    """(name) from (path): inputs by suffix, without noise, distinct and sorted."""
    file = F.regexp_extract("path", r"([^/]+)$", 1)
    suffix = F.lower(F.regexp_extract(file, r"\.([^.]+)$", 1))
    return paths.where(suffix.isin(SUFFIXES) & ~F.col("path").rlike(NOISE)).select(F.regexp_replace(file, r"\.[^.]+$", "").alias("name")).distinct().orderBy("name")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole files as JSON; a malformed one gets status 'error' instead of failing the read."""
    rows = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").option("multiLine", "true").json(path)
    return rows.withColumn("status", F.when(F.col("_bad").isNotNull(), "error").otherwise("ok")).drop("_bad")


def tensor_header(content: Column) -> Column:
    """map<name, struct<dtype, shape>> of a tensor file's bytes: 8 bytes of little-endian length, then JSON.

    Null where the length is beyond the file or MAX_HEADER. For small files whose bytes are at hand;
    ``tensorfiles`` reads headers alone.
    """
    size = F.conv(F.concat(*[F.hex(F.substring(content, 8 - i, 1)) for i in range(8)]), 16, 10).cast("long")
    text = F.substr(content, F.lit(9), size.cast("int")).cast("string")
    parsed = F.from_json(text, "map<string, struct<dtype: string, shape: array<int>>>")
    return F.when((size > 0) & (size <= MAX_HEADER) & (size <= F.length(content) - 8), F.map_filter(parsed, lambda k, v: k != "__metadata__"))


def inventory(files: DataFrame) -> DataFrame:
    """(path, name, dtype, shape, duplicate) of all tensors in (path, content), by name; a name in two files is a duplicate."""
    rows = files.select("path", F.explode(tensor_header(F.col("content"))).alias("name", "t")).select("path", "name", "t.dtype", "t.shape")
    return rows.withColumn("duplicate", F.count("*").over(Window.partitionBy("name")) > 1).orderBy("name", "path")


def check_inventory(tensors: DataFrame, required: list[str] = REQUIRED, stem: str = REQUIRED[0]) -> DataFrame:
    """(problem, name): missing keys, required ones without dimensions or with one that isn't positive, a stem that isn't rank 4 over 3 channels, duplicates."""
    spark = tensors.sparkSession
    missing = spark.createDataFrame([(x,) for x in required], "name string").join(tensors.select("name"), "name", "left_anti").select(F.lit("missing").alias("problem"), "name")
    bad = lambda what, test: tensors.where(test).select(F.lit(what).alias("problem"), "name")
    shape = bad("shape", F.col("name").isin(required) & ((F.size("shape") == 0) | F.exists("shape", lambda d: d <= 0)))
    odd = bad("stem", (F.col("name") == stem) & ~((F.size("shape") == 4) & F.coalesce(F.get("shape", F.lit(1)) == 3, F.lit(False))))
    twice = tensors.groupBy("name").count().where("count > 1").select(F.lit("duplicate").alias("problem"), "name")
    return missing.unionByName(shape).unionByName(odd).unionByName(twice)


def resolve_snapshot(found: DataFrame, explicit: Column, reference: Column, key: str = "repo") -> DataFrame:
    """(key, path, origin) from (key, path, revision, mtime): explicit path, then the referenced revision, then the newest; null means download."""
    newest = found.groupBy(key).agg(
        F.max_by("path", F.struct("mtime", "path")).alias("newest"), F.max(F.when(F.col("revision") == reference, F.col("path"))).alias("referenced"), F.max(explicit).alias("explicit")
    )
    given = F.nullif(F.trim("explicit"), F.lit(""))
    path = F.coalesce(given, "referenced", "newest")
    origin = F.when(given.isNotNull(), "explicit").when(F.col("referenced").isNotNull(), "reference").when(F.col("newest").isNotNull(), "newest").otherwise("download")
    return newest.select(key, path.alias("path"), origin.alias("origin"))


def cache_dir(environment: dict[str, str], home: str) -> str:
    """The model cache: blank settings don't count, ``~`` is the home folder."""
    for name, tail in (("HF_HUB_CACHE", ""), ("HF_HOME", "/hub")):
        value = environment.get(name, "").strip()
        if value:
            return (home + value[1:] if value.startswith("~") else value).rstrip("/") + tail
    return home + "/.cache/huggingface/hub"


def with_baseline(now: DataFrame, before: DataFrame | None, key: str) -> DataFrame:
    """A baseline with the schema of ``now``, empty if there is none."""
    return before if before is not None else now.where(F.lit(False))
