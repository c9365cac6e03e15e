"""Hybrid retrieval: BM25, entities named by the query and their neighbours, vectors, and a budget of bytes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as tx
from tessera.functions.vectors import cosine
from tessera.operators.engine import Engine
from tessera.plans.program import ANY, INT

# fixed values: parameters of the score
K1, B = 1.2, 0.75
DIRECT, HOP, COSINE_FLOOR = 1.5, 0.4, 0.2
FACT_SHARE, EPISODES, CUT_LEFT, BLOCK_EXTRA = 0.6, 8, 400, 24
# fixed values: relations that are bookkeeping and aren't shown
INTERNAL = ("entity alias aliased same_as maps_to alias_conflict describes mentions edge").split()
INTERNAL_PREFIXES = ("cnt_", "__agg:", "__magic", "_magic")


def query_terms(spark: SparkSession, query: str) -> list[str]:
    return sorted(set(spark.range(1).select(tx.tokens(F.lit(query)).alias("t")).first()["t"]))


def bm25(docs: DataFrame, query: str, id_col: str = "id", text: str = "text", keep: list[str] = ()) -> DataFrame:
    """(id, *keep, score) for every document. Term frequencies are counted inside each row and the corpus' statistics are one
    aggregate over the query's terms, so no document is exploded or shuffled."""
    terms = query_terms(docs.sparkSession, query)
    t = F.transform(F.array(tx.tokens(F.col(text))), lambda ts: F.struct(F.size(ts).alias("len"), F.array(*[F.size(F.filter(ts, _is(q))) for q in terms]).alias("tf")))[0]
    counted = docs.select(id_col, *keep, t.alias("_t"))
    stats = counted.agg(
        F.count(F.lit(1)).alias("n"), F.avg("_t.len").alias("avg"), *[F.count(F.when(F.col("_t.tf")[i] > 0, 1)).alias(f"df{i}") for i in range(len(terms))]
    ).first()
    average = stats["avg"] or 1.0
    score = F.lit(0.0)
    for i in range(len(terms)):
        f = F.col("_t.tf")[i].cast("double")
        idf = F.log(F.lit((stats["n"] - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5) + 1.0))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_t.len") / F.lit(average)))
    return counted.select(id_col, *keep, score.alias("score"))


def _is(term: str):
    return lambda x: x == term


def is_internal(pred: str) -> bool:
    return pred in INTERNAL or pred.startswith(INTERNAL_PREFIXES) or "@" in pred


def fact_documents(engine: Engine) -> DataFrame:
    """(id, text, entities, bridge, prov): one row for each fact of the shown relations. The middle of three or more arguments is a
    relation's name: it may be matched but doesn't bridge its facts' subjects."""
    engine.flush()
    parts = []
    for pred in sorted(engine.types()):
        kinds = engine.types()[pred]
        if is_internal(pred) or not kinds:
            continue
        df = engine.facts(pred)
        shown = [F.coalesce(F.col(f"p{i}")["i"].cast("string"), F.col(f"p{i}")["s"]) if k == ANY else F.col(f"p{i}").cast("string") for i, k in enumerate(kinds)]
        names = [F.lit(None).cast("string") if k == INT else F.col(f"p{i}")["s"] if k == ANY else F.col(f"p{i}") for i, k in enumerate(kinds)]
        present = lambda xs: F.filter(F.array(*xs), lambda x: x.isNotNull()) if xs else F.expr("cast(array() as array<string>)")
        bridge = [n for i, n in enumerate(names) if not (len(kinds) >= 3 and i == 1)]
        text = F.concat(F.lit(f"{pred}("), F.array_join(F.array(*shown), ", "), F.lit(")"))
        prov = F.col("_prov") if "_prov" in df.columns else F.expr("cast(array() as array<string>)")
        parts.append(df.select(F.xxhash64(text).alias("id"), text.alias("text"), present(names).alias("entities"), present(bridge).alias("bridge"), prov.alias("prov")))
    if not parts:
        return engine.spark.createDataFrame([], "id long, text string, entities array<string>, bridge array<string>, prov array<string>")
    return reduce(DataFrame.unionByName, parts)


def entity_weights(facts: DataFrame, query: str, aliases: DataFrame | None = None) -> DataFrame:
    """(name, weight): entities whose name the query contains, and the entities one fact (or alias cluster) away from them."""
    names = facts.select(F.explode("entities").alias("name")).distinct()
    low = F.lower("name")
    direct = names.where((F.octet_length(low) >= 2) & F.contains(F.lit(query.lower()), low))
    near = facts.select(F.explode("bridge").alias("name"), "bridge").join(F.broadcast(direct), "name").select(F.explode("bridge").alias("name")).distinct()  # direct: runs of the query
    if aliases is not None:
        from tessera.operators.graphs import components

        parts = components(aliases.select(F.col(aliases.columns[0]).alias("a"), F.col(aliases.columns[1]).alias("b")))
        mine = parts.join(direct, parts["node"] == direct["name"], "left_semi").select("component").distinct()
        near = near.union(parts.join(mine, "component").select("node")).distinct()
    hops = near.join(direct, "name", "left_anti")
    return direct.select("name", F.lit(DIRECT).alias("weight")).unionByName(hops.select("name", F.lit(HOP).alias("weight")))


def rank_facts(facts: DataFrame, query: str, aliases: DataFrame | None = None, vectors: DataFrame | None = None, query_vector: list[float] | None = None) -> DataFrame:
    """(id, text, prov, score) of the facts with a positive score. ``vectors``: (id, vector) of facts."""
    scored = bm25(facts, query, keep=["text", "entities", "prov"])
    top = scored.agg(F.max("score")).first()[0] or 0.0
    weights = entity_weights(facts, query, aliases)
    boost = scored.select("id", F.explode("entities").alias("name")).join(weights, "name").groupBy("id").agg(F.sum("weight").alias("boost"))
    out = scored.join(boost, "id", "left").withColumn("score", F.col("score") / (top if top > 0 else 1.0) + F.coalesce("boost", F.lit(0.0)))
    if vectors is not None:
        close = vectors.select("id", cosine(F.col(vectors.columns[1]), F.array(*[F.lit(float(x)) for x in query_vector])).alias("c")).where(F.col("c") > COSINE_FLOOR)
        out = out.join(close, "id", "left").withColumn("score", F.col("score") + F.coalesce("c", F.lit(0.0)))
    return out.where("score > 0").select("id", "text", "prov", "score")


def budget_prefix(ranked: DataFrame, budget_bytes: int, order: list[Column], text: str = "text", least_bytes: int = 5) -> DataFrame:
    """The best rows up to the first that overflows the budget (a line end counts as a byte). No line is shorter than
    ``least_bytes`` with its end, which bounds the rows that the running sum sees."""
    top = ranked.orderBy(*order).limit(max(1, budget_bytes // least_bytes + 1))
    running = F.sum(F.octet_length(text) + 1).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return top.withColumn("used", running).where(F.col("used") <= budget_bytes)


def select(engine: Engine, episodes: DataFrame, query: str, budget_tokens: int, vectors: DataFrame | None = None, query_vector: list[float] | None = None) -> dict:
    """The facts and episodes that a query's context shows: {facts: [(text, score)], episodes: [(id, text)], used_tokens}."""
    facts = fact_documents(engine)
    aliases = engine.facts("alias") if "alias" in engine.types() else None
    ranked = rank_facts(facts, query, aliases, vectors, query_vector)
    budget = budget_tokens * 4
    chosen = budget_prefix(ranked, int(budget * FACT_SHARE), [F.desc("score"), F.asc("text")]).orderBy(F.desc("score"), "text").collect()
    used = sum(len(r["text"].encode()) + 1 for r in chosen)
    sources = sorted({p for r in chosen for p in r["prov"]})
    from_facts = F.col("id").isin(sources) if sources else F.lit(False)
    order = bm25(episodes, query, keep=["text"]).withColumn("mine", from_facts).orderBy(F.desc("mine"), F.desc("score"), "id")
    picked, left = [], budget - used
    for r in order.toLocalIterator():
        if len(picked) >= EPISODES or left <= BLOCK_EXTRA:
            break
        size = len(r["text"].encode()) + BLOCK_EXTRA
        if size <= left:
            picked.append((r["id"], r["text"]))
            left -= size
        elif left > CUT_LEFT:
            picked.append((r["id"], r["text"][: left - BLOCK_EXTRA]))
            left = 0
    return {"facts": [(r["text"], r["score"]) for r in chosen], "episodes": picked, "used_tokens": (budget - left) // 4}


def render(selection: dict) -> str:
    lines = ["== memory (facts) ==", *[t for t, _ in selection["facts"]], "", "== source episodes =="]
    return "\n".join([*lines, *[f"[{i}] {t}" for i, t in selection["episodes"]]]) + "\n"


def top_k(vectors: DataFrame, query_vector: list[float], k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k rows with the largest cosine; equal ones by id. Each task keeps its own k."""
    score = cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query_vector]))
    return vectors.select(id_col, score.alias("score")).orderBy(F.desc("score"), id_col).limit(k)
