r"""Operator 10: URL filters by rules and by a tree of path templates.

Rules on hosts and path prefixes decide first. Where none fits, the url's template decides. Per host the segments of all paths form
a tree of any depth. Variable segments (digits, long hexadecimal, over-long) are wildcards from the start. A branch then merges with
its siblings into one wildcard where it is statistically like all of them together: in what follows it (the path's end, a
variable segment, a word) and, if it has labelled pages, in its share of blocked ones. A page is judged by the longest part of
its template that holds MIN_LABELLED labelled pages: that is rejected if its share of blocked pages, smoothed by a prior, is high,
and so are the pages without labels that merged into it. Unlabelled pages weigh a little towards the mean of all.

Labels are the rules' own verdicts, or given ones. Only DataFrame functions. All branches are counted first, so a frequent host
or template is as small as any other from then on; prefixes are named by chained 64-bit hashes, so that a long path stays linear.

Defined cases: a url that is null or has no ``://`` has an empty host and path, fits no rule and is allowed; a path without segments
has no template and is allowed; an empty path doesn't start with ``/``; repeated rows are judged and returned each; an empty table
gives an empty result; other columns aren't read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import let, quoted, stored, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path). A list of rules goes into the plan as a literal, so it is bounded.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MAX_RULES = 1000
#: Labelled pages that a template needs, the least smoothed share of blocked ones that rejects it, the weight of the prior in pages
#: and what an unlabelled page adds to it, and how far apart like branches may lie: so many standard deviations of a share.
MIN_LABELLED, MIN_PURITY, PRIOR_WEIGHT, UNLABELLED_WEIGHT, ALIKE = 5, 0.9, 2.0, 0.02, 2.0
#: Rejected branches are broadcast up to this number (some 40 bytes each), else joined by shuffle.
BROADCAST_BRANCHES = 500_000
VARIABLE = r"^(?:[0-9]+(?:\.[a-z]+)?|[0-9a-f]{12,}|.{40,})$"


def parts(url: Column) -> tuple[Column, Column]:
    host = F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))
    return host, F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct(verdict, rule) of the longest rule that fits, else null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    best = F.lit(None)
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        best = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(best)
    return best


def segments(path: Column) -> Column:
    """The path's segments, variable ones as wildcards."""
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.when(s.rlike(VARIABLE), F.lit("*")).otherwise(s))


def prefixes(segs: Column) -> Column:
    """Hashes of an array's prefixes, from the empty one to the whole."""
    start = F.array(F.lit(0).cast("long"))
    return F.aggregate(segs, start, lambda a, s: F.array_append(a, F.xxhash64(F.element_at(a, -1), s)))


COUNTS = ("n", "l", "b")


def wildcards(nodes: DataFrame) -> DataFrame:
    """(host, node, star): whether a branch merges into its parent's wildcard, from rows (host, parent, node, ends, variable, word, n,
    l labelled, b blocked)."""
    shapes = ("ends", "variable", "word")
    own = nodes.groupBy("host", "parent", "node").agg(*[F.sum(c).alias(c) for c in (*shapes, *COUNTS)])
    up = own.groupBy("host", "parent").agg(*[F.sum(c).alias(f"p{c}") for c in (*shapes, *COUNTS)])
    both = own.join(up, ["host", "parent"])
    apart = sum((F.abs(F.col(c) / F.col("n") - F.col(f"p{c}") / F.col("pn")) for c in shapes), F.lit(0.0)) / 2
    shaped = apart <= ALIKE * F.sqrt(1 / F.col("n")) / 2
    p = F.try_divide("pb", "pl")
    labelled = F.abs(F.try_divide("b", "l") - p) <= ALIKE * F.sqrt(F.try_divide(p * (1 - p), F.col("l")))
    return both.select("host", "node", (shaped & F.coalesce(labelled, F.lit(True))).alias("star"))


def rejected_templates(branches: DataFrame) -> DataFrame:
    """(host, leaf) of the branches whose template is rejected. ``branches``: (host, segs, leaf, n pages, l labelled, b blocked), leaf
    being the hash of segs."""
    total = branches.agg(F.sum("l").alias("l"), F.sum("b").alias("b")).first()
    mean = (total["b"] or 0) / (total["l"] or 1)
    cut = branches.where(F.size("segs") > 0).withColumn("h", prefixes(F.col("segs")))
    at = cut.select("host", "leaf", "segs", "h", *COUNTS, F.posexplode("segs").alias("i", "seg"))
    after = F.get("segs", F.col("i") + 1)
    kinds = {"ends": after.isNull(), "variable": after == "*", "word": after != "*"}
    nodes = at.select("host", "leaf", "i", "seg", F.get("h", F.col("i")).alias("parent"), F.get("h", F.col("i") + 1).alias("node"), *COUNTS, *[F.when(k, F.col("n")).otherwise(0).alias(name) for name, k in kinds.items()])
    starred = nodes.select("host", "leaf", "i", "seg", "node").join(wildcards(nodes), ["host", "node"])
    named = F.struct("i", F.when(F.col("star"), F.lit("*")).otherwise(F.col("seg")).alias("seg"))
    templates = starred.groupBy("host", "leaf").agg(F.array_sort(F.collect_list(named)).alias("t")).withColumn("h", prefixes(F.col("t.seg")))
    parts = templates.join(branches.select("host", "leaf", *COUNTS), ["host", "leaf"])
    parts = stored(parts.select("host", "leaf", *COUNTS, F.posexplode(F.slice("h", 2, F.size("h"))).alias("i", "part")), "templates")
    sums = parts.groupBy("host", "part").agg(*[F.sum(c).alias(c) for c in COUNTS]).where(F.col("l") >= MIN_LABELLED)
    weight = PRIOR_WEIGHT + UNLABELLED_WEIGHT * (F.col("n") - F.col("l"))
    bad = (F.col("b") + weight * mean) / (F.col("l") + weight) >= MIN_PURITY
    judged = parts.select("host", "leaf", "i", "part").join(sums.select("host", "part", bad.alias("bad")), ["host", "part"])
    return judged.groupBy("host", "leaf").agg(F.max_by("bad", "i").alias("bad")).where("bad").select("host", "leaf")


def url_filter(pages: DataFrame, url: str = "url", id_col: str = "page_id", rules=RULES, labels: DataFrame | None = None) -> DataFrame:
    """Returns id, host, path, rule, verdict and ``template_rejected`` for each row. ``labels`` (id, bad boolean) may add labels to the rules' own."""
    host, path = parts(quoted(url))
    rows = pages.select(quoted(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumns({"_r": best_rule(F.col("host"), F.col("path"), rules), "segs": segments(F.col("path"))})
    rows = rows.withColumn("leaf", F.element_at(prefixes(F.col("segs")), -1))
    bad = F.when(F.col("_r").isNotNull(), F.col("_r.verdict") == "block")
    if labels is not None:
        given = labels.groupBy(quoted(id_col).alias("_id")).agg(F.max("bad").alias("_given"))
        rows = rows.join(given, "_id", "left")
        bad = F.coalesce(F.col("_given"), bad)
    branches = rows.groupBy("host", "leaf").agg(F.first("segs").alias("segs"), F.count(F.lit(1)).alias("n"), F.count(bad).alias("l"), F.count(F.when(bad, 1)).alias("b"))
    worst = stored(rejected_templates(stored(branches, "branches")), "rejected").withColumn("_bad", F.lit(True))
    if worst.count() <= BROADCAST_BRANCHES:
        worst = F.broadcast(worst)
    out = rows.join(worst, ["host", "leaf"], "left")
    by_tree = F.when(F.col("_bad"), "block").otherwise("allow")
    return out.select(
        F.col("_id").alias(id_col), "host", "path", F.col("_r.rule").alias("rule"), F.coalesce(F.col("_r.verdict"), by_tree).alias("verdict"), F.coalesce("_bad", F.lit(False)).alias("template_rejected")
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


_VARIABLE = "'^(?:[0-9]+(?:\\.[a-z]+)?|[0-9a-f]{12,}|.{40,})$'"
SQL = rf"""
WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), u(v, rh, rp) AS (VALUES {', '.join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)}
), r AS (
  SELECT p.*, f.rule, f.v FROM p LEFT JOIN LATERAL (
    SELECT rh || rp AS rule, v FROM u WHERE (p.host = rh OR ends_with(p.host, '.' || rh)) AND starts_with(p.path, rp) ORDER BY length(rh || rp) DESC LIMIT 1) f ON true
), g AS (
  SELECT *, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, {_VARIABLE}) THEN '*' ELSE x END) AS segs FROM r
), br AS (
  SELECT host, segs, count(*) AS n, count(v) AS l, count(*) FILTER (WHERE v = 'block') AS b FROM g GROUP BY host, segs
), x AS (
  SELECT *, unnest(range(1, len(segs) + 1)) AS i FROM br
), nd AS (
  SELECT host, segs[1:i - 1] AS up, segs[1:i] AS node, sum(n) AS n, sum(l) AS l, sum(b) AS b, coalesce(sum(n) FILTER (WHERE segs[i + 1] IS NULL), 0) AS e,
    coalesce(sum(n) FILTER (WHERE segs[i + 1] = '*'), 0) AS va, coalesce(sum(n) FILTER (WHERE segs[i + 1] <> '*'), 0) AS w FROM x GROUP BY ALL
), pa AS (SELECT host, up, sum(n) AS pn, sum(l) AS pl, sum(b) AS pb, sum(e) AS pe, sum(va) AS pva, sum(w) AS pw FROM nd GROUP BY ALL
), st AS (
  SELECT nd.host, node, (abs(e / n - pe / pn) + abs(va / n - pva / pn) + abs(w / n - pw / pn)) / 2 <= 2.0 * sqrt(1 / n) / 2
    AND (l = 0 OR abs(b / l - pb / pl) <= 2.0 * sqrt((pb / pl) * (1 - pb / pl) / l)) AS star FROM nd JOIN pa ON nd.host = pa.host AND nd.up = pa.up
), tm AS (
  SELECT x.host, x.segs, any_value(n) AS n, any_value(l) AS l, any_value(b) AS b, list(CASE WHEN star THEN '*' ELSE x.segs[i] END ORDER BY i) AS t
  FROM x JOIN st ON st.host = x.host AND st.node = x.segs[1:i] GROUP BY x.host, x.segs
), pt AS (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM tm
), mu AS (SELECT count(*) FILTER (WHERE v = 'block') / count(v) AS mu FROM g
), sm AS (
  SELECT host, t[1:i] AS part, (sum(b) + (2.0 + 0.02 * (sum(n) - sum(l))) * (SELECT mu FROM mu)) / (sum(l) + (2.0 + 0.02 * (sum(n) - sum(l)))) >= 0.9 AS bad
  FROM pt GROUP BY ALL HAVING sum(l) >= 5
), rj AS (
  SELECT pt.host, pt.segs, max_by(bad, i) AS bad FROM pt JOIN sm ON sm.host = pt.host AND sm.part = pt.t[1:i] GROUP BY pt.host, pt.segs
)
SELECT page_id, g.host, path, rule, coalesce(v, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict
FROM g LEFT JOIN rj ON g.host = rj.host AND g.segs = rj.segs
"""
