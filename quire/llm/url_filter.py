"""URL filter: prefix rules first, then the ratio of two character language models.

URLs that a rule allows or blocks are the accepted and the rejected training texts. Each model
is a variable-order Markov model over a small alphabet: a symbol's probability in its longest
seen context of up to ORDER symbols, smoothed by interpolation with the shorter contexts. A
URL's score is the mean log-likelihood difference over its symbols; it is allowed from the
midpoint of the two training sets' means on.

Everything is DataFrame expressions. Counts are combined map-side; the models are broadcast,
at most ALPHABET ** (ORDER + 1) rows whatever the corpus; scoring is one map over distinct URLs.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: a-z, 0-9, '/', '.', '-', any other symbol and the start of a text.
ALPHABET = 41
ORDER = 3
SMOOTH = 2.0
#: Log-likelihood differences are counted in whole millionths, so that sums don't depend on their order.
SCALE = 1_000_000

#: (verdict, host, path): a rule fits its host and all subdomains when the path starts with the rule's.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or a text without '://'."""
    part = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None)
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _grams(urls: DataFrame, keep: list[str]) -> DataFrame:
    """One row per symbol of ``s``: g1 .. g4, the symbol with 0 .. ORDER symbols before it."""
    padded = F.concat(F.lit("^" * ORDER), F.col("s"))
    rows = urls.where("s <> ''").select(*keep, padded.alias("p"), F.explode(F.sequence(F.lit(ORDER + 1), F.length("s") + ORDER)).alias("i"))
    return rows.select(*keep, *[F.substring(F.col("p"), F.col("i") - n, F.lit(n + 1)).alias(f"g{n}") for n in range(ORDER + 1)])


def _models(training: DataFrame) -> list[DataFrame]:
    """For each order a table (gram, d): the log-likelihood difference of the gram's last symbol."""
    rows = _grams(training, ["accepted"])
    full = materialize(
        rows.groupBy(f"g{ORDER}").agg(F.sum("accepted").alias("a"), F.sum(1 - F.col("accepted")).alias("r")).withColumnRenamed(f"g{ORDER}", "g"),
        "grams",
    )
    tables, parent = [], None
    for n in range(ORDER + 1):
        counts = full.groupBy(F.right("g", F.lit(n + 1)).alias("g")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        if n == 0:
            total = full.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("ta"), F.coalesce(F.sum("r"), F.lit(0)).alias("tr"))
            p = lambda c, t: (F.col(c) + 0.5) / (F.col(t) + 0.5 * ALPHABET)
            level = counts.crossJoin(F.broadcast(total)).select("g", p("a", "ta").alias("pa"), p("r", "tr").alias("pr"))  # total is one row
        else:
            context = counts.groupBy(F.left("g", F.lit(n)).alias("c")).agg(F.sum("a").alias("ta"), F.sum("r").alias("tr"))
            low = parent.select(F.col("g").alias("s"), F.col("pa").alias("qa"), F.col("pr").alias("qr"))
            p = lambda c, t, q: (F.col(c) + SMOOTH * F.col(q)) / (F.col(t) + SMOOTH)
            level = (
                counts.withColumn("c", F.left("g", F.lit(n))).withColumn("s", F.right("g", F.lit(n))).join(context, "c").join(low, "s")
                .select("g", p("a", "ta", "qa").alias("pa"), p("r", "tr", "qr").alias("pr"))
            )
        parent = materialize(level, "model")
        tables.append(parent.select(F.col("g").alias(f"m{n}"), F.round((F.ln("pa") - F.ln("pr")) * SCALE).cast("long").alias(f"d{n}")))
    discard(full)
    return tables


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url: str = "url") -> DataFrame:
    """(id_col, host, path, rule, verdict), one row per input row.

    verdict is the longest fitting rule's, else the models': allow from the midpoint of the
    training means on. URLs without symbols, and all URLs if no rule accepts or none rejects
    any, score 0 against 0: allowed. Null ids, null URLs and repeats are rows like others.
    """
    host, path = host_and_path(F.col(url))
    judged = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    judged = materialize(judged.withColumn("r", longest_rule(F.col("host"), F.col("path"), rules)).select("id", "host", "path", "r.rule", "r.verdict"), "judged")
    text = F.regexp_replace(F.lower(F.concat("host", "path")), "[^a-z0-9./-]", "~").alias("s")
    training = judged.where("rule is not null").select(text, F.when(F.col("verdict") == "allow", 1).otherwise(0).alias("accepted"))
    models = _models(training)

    urls = judged.select("host", "path", text, F.when(F.col("rule").isNull(), F.lit("?")).otherwise(F.col("verdict")).alias("set")).groupBy("host", "path", "s", "set").agg(F.count("*").alias("times"))
    rows = _grams(urls, ["host", "path", "set", "times"])
    for n, m in enumerate(models):
        rows = rows.join(F.broadcast(m), rows[f"g{n}"] == m[f"m{n}"], "left").drop(f"m{n}", f"g{n}")  # at most ALPHABET ** (n + 1) rows
    best = F.coalesce(*[F.col(f"d{n}") for n in reversed(range(ORDER + 1))], F.lit(0))
    scores = materialize(rows.groupBy("host", "path", "set", "times").agg(F.sum(best).alias("d"), F.count("*").alias("n")), "scores")
    means = {r["set"]: r.d / r.n for r in scores.where(F.col("set") != "?").groupBy("set").agg(F.sum(F.col("d") * F.col("times")).alias("d"), F.sum(F.col("n") * F.col("times")).alias("n")).collect()}
    middle = (means["allow"] + means["block"]) / 2 if len(means) == 2 else None
    verdict = F.when(F.lit(middle).isNull() | (F.coalesce(F.col("d") / F.col("n"), F.lit(0.0)) >= F.lit(middle if middle is not None else 0.0)), "allow").otherwise("block")
    if middle is None:
        verdict = F.lit("allow")
    # Only URLs that no rule decides and that have symbols meet their scores: a URL without any has none to meet.
    bare = F.lit("") == F.concat("host", "path")
    scored = scores.where(F.col("set") == "?").select("host", "path", "d", "n")
    free = judged.where(F.col("rule").isNull())
    open_ = free.where(~bare).join(scored, ["host", "path"], "left").withColumn("verdict", verdict)
    empty = free.where(bare).withColumns({"d": F.lit(None).cast("long"), "n": F.lit(None).cast("long")}).withColumn("verdict", verdict)
    columns = ["id", "host", "path", "rule", "verdict"]
    out = judged.where(F.col("rule").isNotNull()).select(columns).unionByName(open_.select(columns)).unionByName(empty.select(columns))
    return out.withColumnRenamed("id", id_col)


def _sql() -> str:
    """The rows of judge_urls in DuckDB."""
    fits = lambda h, p: f"((host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}'))"
    order = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in order)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in order)
    ctes = [
        "u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)\\A.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '(?s)\\A.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages)",
        f"j AS (SELECT *, CASE {rule} END AS rule, CASE {verdict} END AS rv, regexp_replace(lower(host || path), '[^a-z0-9./-]', '~', 'g') AS s FROM u)",
        f"pos AS (SELECT page_id, rv, '{'^' * ORDER}' || s AS p, unnest(range({ORDER + 1}, length(s) + {ORDER + 1})) AS i FROM j)",
        "f AS (SELECT g, sum(CASE WHEN rv = 'allow' THEN 1 ELSE 0 END) AS a, sum(CASE WHEN rv = 'block' THEN 1 ELSE 0 END) AS r FROM (SELECT rv, substr(p, i - 3, 4) AS g FROM pos WHERE rv IS NOT NULL) GROUP BY g)",
    ]
    for n in range(ORDER + 1):
        ctes.append(f"c{n} AS (SELECT right(g, {n + 1}) AS g, sum(a)::DOUBLE AS a, sum(r)::DOUBLE AS r FROM f GROUP BY 1)")
        if n == 0:
            ctes.append(f"p0 AS (SELECT g, (a + 0.5::DOUBLE) / ((SELECT sum(a) FROM f)::DOUBLE + {0.5 * ALPHABET}::DOUBLE) AS pa, (r + 0.5::DOUBLE) / ((SELECT sum(r) FROM f)::DOUBLE + {0.5 * ALPHABET}::DOUBLE) AS pr FROM c0)")
        else:
            ctes.append(f"x{n} AS (SELECT left(g, {n}) AS c, sum(a) AS ta, sum(r) AS tr FROM c{n} GROUP BY 1)")
            ctes.append(f"p{n} AS (SELECT c{n}.g, (a + {SMOOTH}::DOUBLE * q.pa) / (ta + {SMOOTH}::DOUBLE) AS pa, (r + {SMOOTH}::DOUBLE * q.pr) / (tr + {SMOOTH}::DOUBLE) AS pr FROM c{n} JOIN x{n} ON x{n}.c = left(c{n}.g, {n}) JOIN p{n - 1} q ON q.g = right(c{n}.g, {n}))")
        ctes.append(f"m{n} AS (SELECT g, CAST(round((ln(pa) - ln(pr)) * {SCALE}) AS BIGINT) AS d FROM p{n})")
    joins = " ".join(f"LEFT JOIN m{n} ON m{n}.g = substr(p, i - {n}, {n + 1})" for n in range(ORDER + 1))
    best = ", ".join(f"m{n}.d" for n in reversed(range(ORDER + 1)))
    ctes.append(f"sc AS (SELECT page_id, rv, sum(coalesce({best}, 0)) AS d, count(*) AS n FROM pos {joins} GROUP BY page_id, rv)")
    ctes.append("t AS (SELECT sum(d) FILTER (rv = 'allow') / sum(n) FILTER (rv = 'allow')::DOUBLE AS a, sum(d) FILTER (rv = 'block') / sum(n) FILTER (rv = 'block')::DOUBLE AS b FROM sc)")
    return f"WITH {', '.join(ctes)} SELECT j.page_id, host, path, rule, coalesce(j.rv, CASE WHEN (SELECT a + b FROM t) IS NULL OR coalesce(d / n::DOUBLE, 0) >= (SELECT (a + b) / 2 FROM t) THEN 'allow' ELSE 'block' END) AS verdict FROM j LEFT JOIN sc ON sc.page_id = j.page_id"


SQL = _sql()
