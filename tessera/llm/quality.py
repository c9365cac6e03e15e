"""Operator 7: quality rules, with verdicts on hosts.

Rules are measured on each document; their failures are aggregated by host, the rates of failure are shrunk with a
beta prior fitted to all hosts, and the hosts' verdicts are joined back. Only DataFrame functions are used.

Defined cases: null and empty texts have no words and fail the base rule; a null host is a host of its own; repeated
rows are measured and returned each; an empty table gives an empty result; other columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, fresh, let, quoted, stored, table, word_array

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A host is rejected if the shrunk rate of failure of one of its rules is above this.
MAX_HOST_RATE = 0.5
#: Bounds of the prior's weight in documents.
PRIOR_WEIGHT = (1.0, 1000.0)
RULES = ("few_words", "repeats", "symbols", "lines")


def repeated_words(words: Column) -> Column:
    """Number of words that lie in a 3-word window found twice or more: sort the windows' hashes with their places,
    keep those equal to a neighbour, and add up the union of their intervals."""
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("p")),
    )

    def places(s: Column) -> Column:
        same = F.transform(s, lambda x, i: F.when((x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]), x["p"]))
        return F.sort_array(F.filter(same, lambda p: p.isNotNull()))

    def covered(p: Column) -> Column:
        return F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x
        )

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(F.sort_array(windows), lambda s: let(places(s), covered)))


def measured(docs: DataFrame) -> DataFrame:
    """From (id, host, text) the same with a struct ``_q`` of the rules' measures."""
    t = F.coalesce(F.col("text"), F.lit(""))
    by_words = let(
        word_array(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words"))
    )
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    dup = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    return docs.withColumn("_w", by_words).withColumn(
        "_q",
        F.struct(
            F.col("_w.n_words"),
            F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            dup.alias("n_dup_lines"),
            F.col("_w.n_repeat_words"),
        ),
    ).drop("_w")


def rule_failures() -> dict[str, Column]:
    q = lambda name: F.col(f"_q.{name}")
    return {
        "few_words": q("n_words") < MIN_WORDS,
        "repeats": 100 * q("n_repeat_words") > MAX_REPEAT_PERCENT * q("n_words"),
        "symbols": 10 * q("n_symbols") > q("word_chars"),
        "lines": 10 * q("n_dup_lines") > q("n_words"),
    }


def host_verdicts(judged: DataFrame) -> DataFrame:
    """One row per host: (host, n, rates, host_ok), from rows with ``host`` and a boolean per rule.

    The prior of a rule is a beta distribution with the mean of all documents and the weight that the spread of the
    hosts' rates gives by the method of moments."""
    hosts = judged.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(r).cast("long")).alias(r) for r in RULES])
    hosts = stored(hosts, "hosts")
    total = hosts.agg(
        F.sum("n").alias("n"),
        *[F.sum(r).alias(r) for r in RULES],
        *[F.sum(F.col(r) * F.col(r) / F.col("n")).alias(f"sq_{r}") for r in RULES],
    ).first()
    rates = []
    for r in RULES:
        n = total["n"] or 1
        mean = (total[r] or 0) / n
        spread = max((total[f"sq_{r}"] or 0.0) / n - mean * mean, 1e-12)
        weight = min(max(mean * (1 - mean) / spread - 1, PRIOR_WEIGHT[0]), PRIOR_WEIGHT[1])
        rates.append(((F.col(r) + mean * weight) / (F.col("n") + weight)).alias(f"rate_{r}"))
    ok = ~F.greatest(*[F.col(f"rate_{r}") for r in RULES]).__gt__(MAX_HOST_RATE)
    return hosts.select("host", "n", *rates).withColumn("host_ok", ok)


def quality(docs: DataFrame, text: str = "text", host: str = "source", id_col: str = "doc_id") -> DataFrame:
    """Returns id, the measures, ``base_failed``, the rules, ``host_ok`` and ``kept`` for each row of ``docs``; its other columns
    aren't read."""
    rows = measured(docs.select(quoted(id_col).alias("_id"), quoted(host).alias("host"), quoted(text).alias("text")))
    rows = rows.select(F.col("_id").alias(id_col), "host", "_q.*", *[c.alias(r) for r, c in rule_failures().items()])
    rows = stored(rows, "quality")
    verdicts = host_verdicts(rows).select(F.col("host").alias("_host"), "host_ok")
    base = F.col("few_words") | F.col("repeats")
    joined = rows.join(verdicts, F.col("host").eqNullSafe(F.col("_host")), "left").drop("_host")
    return joined.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & F.col("host_ok"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go. Verdicts meet the rows by id, which may repeat: equal ids with different texts are told apart by the text's hash."""
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("source"), F.lit("")))
    judged = quality(docs.select(F.struct(F.col("doc_id"), key.alias("k")).alias("row"), "source", "text"), id_col="row").where("kept")
    d, k = fresh(docs.columns, "_d", "_k")
    kept = judged.select(F.col("row.doc_id").alias(d), F.col("row.k").alias(k)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(d)) & (key == F.col(k)), "left_semi")


SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT doc_id, unnest(range(1, len(ws) - 1)) AS p, ws FROM w WHERE len(ws) >= 3
), h AS (
  SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, ws[p], ws[p + 1], ws[p + 2]) AS c FROM g
), r AS (
  SELECT doc_id, count(DISTINCT p + d) AS n_repeat_words FROM h, (VALUES (0), (1), (2)) AS o(d) WHERE c >= 2 GROUP BY doc_id
), m AS (
  SELECT w.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
       - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN r USING (doc_id)
), f AS (
  SELECT *, n_words < 50 AS f1, 100 * n_repeat_words > 50 * n_words AS f2, 10 * n_symbols > word_chars AS f3, 10 * n_dup_lines > n_words AS f4 FROM m
), hs AS (
  SELECT source, k, count(*) AS n, count(*) FILTER (WHERE b) AS x
  FROM (SELECT source, unnest([1, 2, 3, 4]) AS k, unnest([f1, f2, f3, f4]) AS b FROM f) GROUP BY source, k
), pr AS (
  SELECT k, sum(x) / sum(n) AS mu, greatest(sum(x * x / n) / sum(n) - (sum(x) / sum(n)) ** 2, 1e-12) AS v FROM hs GROUP BY k
), pw AS (
  SELECT k, mu, least(greatest(mu * (1 - mu) / v - 1, 1.0), 1000.0) AS wt FROM pr
), ok AS (
  SELECT source, max((x + mu * wt) / (n + wt)) <= 0.5 AS host_ok FROM hs JOIN pw USING (k) GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 OR f2 AS base_failed, NOT (f1 OR f2) AND host_ok AS kept
FROM f JOIN ok ON f.source IS NOT DISTINCT FROM ok.source
"""
