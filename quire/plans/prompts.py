"""Queries over page selections, prompts and token positions, with the same rows in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import pages as P
from quire.operators import prompts as O
from quire.sources import derived as S

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_LO = "l_partkey % 40 + 1"
_HI = "l_partkey % 40 + 1 + l_suppkey % 5"


@query(f"SELECT l_orderkey, array_to_string(list_sort(list_distinct(flatten(list(range({_LO}, {_HI} + 1))))), ',') AS pages FROM lineitem GROUP BY 1")
def pages_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = S.table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(F.expr(_LO).alias("lo"), F.expr(_HI).alias("hi")).alias("r"))
    return r.groupBy("l_orderkey").agg(F.array_join(P.page_list(F.collect_list("r")).cast("array<string>"), ",").alias("pages"))


@query(f"WITH r AS (SELECT l_orderkey, {_LO} AS lo, {_HI} AS hi FROM lineitem), n AS (SELECT *, CASE WHEN coalesce(lo > max(hi) OVER (PARTITION BY l_orderkey ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, true) THEN 1 ELSE 0 END AS nw FROM r), i AS (SELECT *, sum(nw) OVER (PARTITION BY l_orderkey ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM n) SELECT l_orderkey, min(lo) AS lo, max(hi) AS hi FROM i GROUP BY l_orderkey, g")
def range_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.merge_ranges(S.table(spark, sf_dir, "lineitem").select("l_orderkey", F.expr(_LO).alias("lo"), F.expr(_HI).alias("hi")), "l_orderkey")


_TASK = "CASE turn % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'table' WHEN 2 THEN 'formula' WHEN 3 THEN 'structured' ELSE 'other' END"
_Q = lambda s: "'" + s.replace("'", "''") + "'"
_PROMPT = f"CASE t WHEN 'text' THEN {_Q(O.PROMPTS['text'])} WHEN 'table' THEN {_Q(O.PROMPTS['table'])} WHEN 'formula' THEN {_Q(O.PROMPTS['formula'])} WHEN 'structured' THEN {_Q(O.SCHEMA_PROMPT)} || text ELSE {_Q(O.DEFAULT_PROMPT)} END"


@query(f"SELECT conv_id, turn, t AS task, '<image>' || chr(10) || {_PROMPT} AS prompt FROM (SELECT *, {_TASK} AS t FROM conversations)")
def task_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = S.table(spark, sf_dir, "conversations").withColumn("task", F.expr(_TASK))
    return c.select("conv_id", "turn", "task", O.task_prompt(F.col("task"), F.col("text")).alias("prompt"))


@query("SELECT conv_id, turn, CASE WHEN turn % 4 > 0 THEN '[gMASK]<sop>' || chr(10) || '<|user|>' || chr(10) || '<|' || role || '|>' || '<|begin_of_image|>' || repeat('<|image|>', turn % 4) || '<|end_of_image|>' || chr(10) || text || chr(10) || '/nothink' || chr(10) || '<|assistant|>' || chr(10) END AS rendered FROM conversations")
def chat_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = S.table(spark, sf_dir, "conversations").withColumn("s", O.split_placeholder(F.concat(F.lit("<|"), F.col("role"), F.lit("|><image>\n"), F.col("text"))))
    return c.select("conv_id", "turn", O.chat_prompt(F.col("s.before"), (F.col("turn") % 4).cast("int"), F.col("s.after"), think=False).alias("rendered"))


@query("WITH t AS (SELECT o_orderkey, i AS pos, (o_orderkey * 7 + i * 3) % 4 AS token FROM (SELECT o_orderkey, unnest(range(0, 12)) AS i FROM orders)), k AS (SELECT *, CASE WHEN token = 2 THEN sum(CASE WHEN token = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY o_orderkey ORDER BY pos) END AS k FROM t) SELECT o_orderkey, CAST(pos AS INT) AS pos, token, CAST(k AS BIGINT) AS k, CAST(o_orderkey * 100 + k AS BIGINT) AS row_id FROM k")
def fuse_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = S.table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("pos"))
    t = o.withColumn("token", (F.col("o_orderkey") * 7 + F.col("pos") * 3) % 4)
    v = t.where("token = 2").groupBy("o_orderkey").agg(F.count("*").alias("n")).select("o_orderkey", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("k"))
    return O.fuse(t, v.withColumn("row_id", F.col("o_orderkey") * 100 + F.col("k")), "o_orderkey", 2).select("o_orderkey", "pos", "token", "k", "row_id")


@query("WITH t AS (SELECT event_id, i AS pos, (event_id // 3 + i * i) % 5 < 2 AS kind FROM (SELECT event_id, unnest(range(0, 10)) AS i FROM events)), c AS (SELECT *, CASE WHEN kind IS NOT DISTINCT FROM lag(kind) OVER (PARTITION BY event_id ORDER BY pos) THEN 0 ELSE 1 END AS c FROM t), r AS (SELECT *, CAST(sum(c) OVER (PARTITION BY event_id ORDER BY pos) AS INT) AS run FROM c) SELECT event_id, run, kind, min(pos) AS first, count(*) AS n FROM r GROUP BY 1, 2, 3")
def token_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.table(spark, sf_dir, "events").select("event_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("pos"))
    return O.token_runs(e.withColumn("kind", F.expr("(event_id div 3 + pos * pos) % 5 < 2")), "event_id", "kind")


# 24 tokens a part: 9 is an image's, 7 and 8 begin and end a video. Some grids aren't filled, some parts have a second image or a video.
_GRID = {"grid_t": "CASE WHEN p_partkey % 23 = 5 THEN NULL ELSE CAST(1 + p_partkey % 2 AS INT) END", "grid_h": "CAST(2 + p_size % 3 * 2 + p_partkey % 2 AS INT)", "grid_w": "CAST(2 + p_partkey % 3 * 2 AS INT)"}
_FILL = "(1 + p_partkey % 2) * (1 + p_size % 3) * (1 + p_partkey % 3) - CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END"
_TOKEN = f"CAST(CASE WHEN p_partkey % 13 = 0 AND pos = 0 THEN 7 WHEN p_partkey % 26 = 0 AND pos = 1 THEN 8 WHEN p_partkey % 11 = 0 AND pos = 23 THEN 9 WHEN p_partkey % 10 <> 9 AND pos >= p_partkey % 5 AND pos < p_partkey % 5 + {_FILL} THEN 9 ELSE pos % 7 END AS INT)"
_AT = {"p_t": "(pos - s) // (h * w)", "p_h": "(pos - s) % (h * w) // w", "p_w": "(pos - s) % w"}


@query(f"""WITH t AS (SELECT p_partkey, CAST(pos AS INT) AS pos, {_TOKEN} AS token, {', '.join(f'{v} AS {k}' for k, v in _GRID.items())} FROM (SELECT *, unnest(range(0, 24)) AS pos FROM part)),
v AS (SELECT *, last_value(CASE token WHEN 7 THEN true WHEN 8 THEN false END IGNORE NULLS) OVER (PARTITION BY p_partkey ORDER BY pos) AS video FROM t),
k AS (SELECT *, CASE WHEN token <> 9 THEN 'text' WHEN coalesce(video, false) THEN 'video' ELSE 'image' END AS kind FROM v),
b AS (SELECT *, kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY p_partkey ORDER BY pos) AS nw FROM k),
g AS (SELECT *, sum(CASE WHEN nw AND kind = 'image' THEN 1 ELSE 0 END) OVER (PARTITION BY p_partkey ORDER BY pos) AS grp FROM b),
f AS (SELECT p_partkey, min(pos) FILTER (kind = 'image' AND grp = 1) AS s, min(pos) FILTER (kind = 'image' AND grp = 2) AS s2, min(pos) FILTER (kind = 'video') AS vid, count(*) FILTER (kind = 'image' AND grp = 1) AS n,
  any_value(grid_t) AS t, any_value(grid_h) // 2 AS h, any_value(grid_w) // 2 AS w FROM g GROUP BY 1),
p AS (SELECT *, greatest(t, h, w) AS span, CASE WHEN t IS NULL THEN 'no image grid' WHEN s IS NOT NULL AND t * h * w <> n AND s < coalesce(vid, 99) THEN 'image tokens differ: expected ' || (t * h * w) || ', found ' || n
  WHEN least(coalesce(s2, 99), coalesce(vid, 99)) < 99 THEN CASE WHEN coalesce(s2, 99) < coalesce(vid, 99) THEN 'more than one image' ELSE 'video isn''t supported' END END AS problem FROM f)
SELECT p_partkey, pos, {', '.join(f"CASE WHEN problem IS NULL THEN CAST(CASE WHEN kind = 'image' THEN s + {v} WHEN s IS NOT NULL AND pos >= s + n THEN pos - n + span ELSE pos END AS INT) END AS {a}" for a, v in _AT.items())},
  CASE WHEN problem IS NULL THEN CAST(CASE WHEN s IS NULL THEN 0 ELSE span - n END AS INT) END AS delta, problem FROM g JOIN p USING (p_partkey)""")
def rope_position_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = S.table(spark, sf_dir, "part").withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(23))))
    t = p.select("p_partkey", "pos", F.expr(_TOKEN).alias("token"), *[F.expr(v).alias(k) for k, v in _GRID.items()])
    return O.rope_positions(t, "p_partkey", 9, video_start=7, video_end=8).select("p_partkey", "pos", "p_t", "p_h", "p_w", "delta", "problem")


# Specifications of every kind, from numbers of an order's lines; documents have 0 to 29 pages.
_A, _B = "CAST(l_partkey % 30 AS VARCHAR(9))", "CAST(l_suppkey % 12 + 1 AS VARCHAR(9))"
_FORMS = [
    "'all'", "' ALL '", "'  '", "NULL", f"concat({_A}, '-', {_B})", f"concat({_B}, ', [', {_A}, ' - ', CAST(l_partkey % 30 + l_suppkey % 4 AS VARCHAR(9)), '], ', {_A})", f"concat('[', {_A})", f"concat({_A}, ']')",
    f"concat({_A}, ',,', {_B})", f"concat('all,', {_A})", f"concat({_B}, ',', {_A}, ',', CAST(l_partkey % 30 + 1 AS VARCHAR(9)))", f"concat('p', {_A})", f"concat('1-', {_A}, '-3')", "'[]'", f"concat('+', {_B}, ',[', {_B}, ']')", "'all, all'", "'99999999999999999999'",
]
_SPEC = "CASE (l_orderkey + l_linenumber) % 17 " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(_FORMS)) + " END"
_WHOLE = lambda x: f"CASE WHEN regexp_full_match({x}, '\\+?[0-9]+') THEN TRY_CAST({x} AS BIGINT) END"


@query(f"""WITH l AS (SELECT l_orderkey, l_linenumber, {_SPEC} AS spec, CAST(l_suppkey % 30 AS INT) AS n FROM lineitem),
d AS (SELECT DISTINCT spec FROM l WHERE trim(coalesce(spec, '')) <> ''),
t AS (SELECT spec, trim(unnest(string_split(trim(spec), ','))) AS t, unnest(range(len(string_split(trim(spec), ',')))) AS i FROM d),
o AS (SELECT *, lower(t) = 'all' AS every, CASE WHEN NOT (starts_with(t, '[') OR ends_with(t, ']')) THEN t WHEN starts_with(t, '[') AND ends_with(t, ']') AND length(t) > 1 THEN substring(t, 2, length(t) - 2) END AS body FROM t),
e AS (SELECT *, string_split(replace(body, ' ', ''), '-') AS ends FROM o),
r AS (SELECT *, {_WHOLE('ends[1]')} AS lo, CASE len(ends) WHEN 1 THEN {_WHOLE('ends[1]')} WHEN 2 THEN {_WHOLE('ends[2]')} END AS hi FROM e),
w AS (SELECT *, CASE WHEN every THEN NULL WHEN t = '' THEN 'empty token' WHEN body IS NULL THEN 'invalid brackets in token ''' || t || '''' WHEN lo IS NULL OR hi IS NULL THEN 'could not parse token ''' || t || ''''
  WHEN lo < 1 THEN 'page must be >= 1 (got ' || lo || ')' WHEN hi < 1 THEN 'page must be >= 1 (got ' || hi || ')' WHEN lo > hi THEN 'range start must be <= end (got ' || lo || '-' || hi || ')' END AS wrong FROM r),
s AS (SELECT spec, coalesce(arg_min(wrong, i) FILTER (wrong IS NOT NULL), CASE WHEN bool_or(every) AND NOT bool_and(every) THEN 'cannot mix ''all'' with explicit page selections' END) AS error, bool_and(every) AS every FROM w GROUP BY 1),
m AS (SELECT *, CASE WHEN coalesce(lo > max(hi) OVER (PARTITION BY spec ORDER BY lo, hi, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, true) THEN 1 ELSE 0 END AS nw FROM w SEMI JOIN (SELECT spec FROM s WHERE error IS NULL AND NOT every) USING (spec)),
g AS (SELECT spec, min(lo) AS lo, max(hi) AS hi FROM (SELECT *, sum(nw) OVER (PARTITION BY spec ORDER BY lo, hi, i ROWS UNBOUNDED PRECEDING) AS gr FROM m) GROUP BY spec, gr),
q AS (SELECT spec, string_agg(lo || '-' || hi, ',' ORDER BY lo) AS ranges, CAST(sum(hi - lo + 1) AS BIGINT) AS pages, list(hi ORDER BY lo) AS his FROM g GROUP BY 1),
a AS (SELECT l.*, coalesce(s.every, true) AS every, s.error AS unread, q.ranges, q.pages AS asked, list_filter(q.his, lambda x: x > l.n)[1] AS past FROM l LEFT JOIN s ON s.spec = l.spec LEFT JOIN q ON q.spec = l.spec),
z AS (SELECT *, coalesce(unread, CASE WHEN n < 1 THEN 'invalid PDF page count ' || n END, CASE WHEN past IS NOT NULL THEN 'page ' || past || ' is out of range (pageCount=' || n || ')' END) AS error FROM a)
SELECT l_orderkey, l_linenumber, spec, ranges, error, CASE WHEN error IS NULL THEN CASE WHEN every THEN CAST(n AS BIGINT) ELSE asked END END AS n_pages FROM z""")
def page_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = S.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_SPEC.replace("VARCHAR(9)", "STRING")).alias("spec"), F.expr("CAST(l_suppkey % 30 AS INT)").alias("n"))
    read = lines.withColumn("r", P.read_specs(F.col("spec")))
    read = read.withColumn("p", P.resolve_specs(F.col("r"), F.col("n")))
    ranges = F.array_join(F.transform("r.ranges", lambda x: F.concat(x["lo"].cast("string"), F.lit("-"), x["hi"].cast("string"))), ",")
    return read.select("l_orderkey", "l_linenumber", "spec", ranges.alias("ranges"), "p.error", F.when(F.col("p.error").isNull(), F.size("p.pages").cast("long")).alias("n_pages"))
