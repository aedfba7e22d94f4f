"""From raw documents to shards: toxicity, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the
columns of ``documents``; the last returns the sharding report. ``run`` writes each stage's rows
to the scratch folder and reads them back as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, mixing, ngram_join, sharding, toxicity
from quire.llm.common import discard, materialize, table
from quire.shipping import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Rows to leave out are broadcast up to this many (a few MB), else joined by a shuffle.
ODD_ROWS = 250_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below 0.5; it learns from this stage's labelled rows."""
    ship(spark)
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"), keep=COLUMNS)
    return scored.where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one row, of the smallest id; rows without id or words stay."""
    ship(spark)
    rows = materialize(ngram_join.jaccard_classes(docs, with_class=True).where("class is not null"), "classes")
    # A class keeps a row of its smallest id, that of the smallest hash where the id has several texts.
    at = ["doc_id", "text_hash"]
    heads = rows.where("doc_id = component_id").groupBy("class", "doc_id").agg(F.count("*").alias("n"), F.min("text_hash").alias("head")).where("n > 1")
    heads = materialize(heads, "heads")
    several = rows.where("doc_id = component_id").join(heads.select("class", "doc_id"), ["class", "doc_id"], "left_semi")
    odd = materialize(rows.where("doc_id <> component_id").select(*at).unionByName(several.select(*at)).distinct(), "odd")
    named = docs.select(*COLUMNS, F.xxhash64("text").alias("text_hash"))
    single = named.join(F.broadcast(odd) if odd.count() <= ODD_ROWS else odd, at, "left_anti")
    again = named.join(heads.select("doc_id", F.col("head").alias("text_hash")).distinct(), at, "left_semi").dropDuplicates(at)
    discard(rows)
    return single.select(*COLUMNS).unionByName(again.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any word inside a benchmark window."""
    ship(spark)
    marked = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS)
    return marked.where("not contaminated").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes; a row taken twice comes twice."""
    return mixing.mix_documents(docs.select(*COLUMNS))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sharding report of the mix, one row per row."""
    return sharding.shard_report(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The toxicity model and the k-d tree can't be expressed in SQL; both are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
