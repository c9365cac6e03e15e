r"""Operator 6: near-duplicate vectors by a forest of random-projection trees.

Equal vectors of a label form a class first. Each tree splits space by random directions at the median of a bounded sample;
vectors near a split go to both sides (spill). Where a leaf still holds too many vectors of a label, it is split again by a tree
that is fitted to a sample of its own, in a task, until leaves are small. Classes in the same leaf of a tree, with the same label and
length, are compared by cosine in double precision; large leaves in blocks, so no task holds more than two blocks.

Links aren't written as pairs. A pair counts in the first leaf that it shares, which both rows' lists of leaves tell; a task adds up each
row's links, and gives one edge for each further row of a component inside its blocks. So what leaves the tasks grows with rows, not
with pairs. The edges of all trees are united.

Samples (SAMPLE rows for all trees, LEAF_SAMPLE for a leaf, chosen by hash) only place the splits; every row is indexed. With so few
rows that no tree splits, the comparison is complete.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows without a label or an id, link with
nothing and are returned with n_links 0; vectors of different lengths don't link; very small and very large components are scaled
first; repeated rows are copies of a class: each links with the others; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import connected_components, quoted, stored, table

TREES, SPILL, SAMPLE, LEAF = 10, 0.10, 20_000, 400
#: A leaf with more rows of a label is split again, by SUBTREE levels, from a sample of LEAF_SAMPLE rows.
LARGE_LEAF, LEAF_SAMPLE, SUBTREE = 4 * LEAF, 4000, 4
#: Copies that the spill of one tree makes of a row, about: deeper trees spill less at each level.
COPIES = 4.0
#: Rows of a block in a leaf's comparison, and pairs whose leaves are compared at a time.
BLOCK, PAIRS = 1500, 20_000
#: Leaves that are split again are broadcast up to this number (some 400 bytes each), else joined by shuffle.
BROADCAST_LEAVES = 50_000
MIN_COSINE = 0.93
TREE_SHIFT = 56

_planes: dict[tuple, np.ndarray] = {}


def usable(vector) -> F.Column:
    """Whether a vector has only finite components and one that isn't zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def plane(dim: int, tree: int, node: int) -> np.ndarray:
    """The random direction of a tree's node; it follows from the numbers alone, so it is never sent."""
    found = _planes.get((dim, tree, node))
    if found is None:
        if len(_planes) * dim > 1 << 23:
            _planes.clear()
        found = _planes[dim, tree, node] = np.random.default_rng([11, dim, tree, node]).standard_normal(dim)
    return found


def fitted(x: np.ndarray, tree: int, top: int, levels: int, spill: float) -> np.ndarray:
    """Cuts (low, middle, high) of the nodes below ``top`` (in heap order, itself first) from a sample of unit vectors."""
    cuts, inside = np.zeros((2**levels - 1, 3)), {0: np.arange(len(x))}
    for k in range(2**levels - 1):
        rows = inside.pop(k)
        at = x[rows] @ plane(x.shape[1], tree, _below(top, k))
        cuts[k] = np.quantile(at, [0.5 - spill, 0.5, 0.5 + spill]) if len(at) else 0
        inside[2 * k + 1], inside[2 * k + 2] = rows[at <= cuts[k, 2]], rows[at >= cuts[k, 0]]
    return cuts


def _below(top: int, k: int) -> int:
    """The node of a tree (the root is 1, node i has the children 2 i and 2 i + 1) that is the k-th in heap order below ``top``."""
    level = (k + 1).bit_length() - 1
    return (top << level) + k + 1 - (1 << level)


def descend(x: np.ndarray, tree: int, top: int, levels: int, cuts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, rows) below ``top``; a row may be in several leaves."""
    todo = [(0, np.arange(len(x)))]
    for _ in range(levels):
        ahead = []
        for k, rows in todo:
            at = x[rows] @ plane(x.shape[1], tree, _below(top, k))
            ahead += [(2 * k + 1, rows[at <= cuts[k, 2]]), (2 * k + 2, rows[at >= cuts[k, 0]])]
        todo = ahead
    for k, rows in todo:
        yield _below(top, k), rows


def spill_of(depth: int) -> float:
    """Share of rows at either side of a split that go to both: at most SPILL, and so that a tree makes COPIES copies at most."""
    return min(SPILL, (COPIES ** (1 / max(depth, 1)) - 1) / 2)


def packed(x: np.ndarray) -> list[bytes]:
    """Vectors as bytes, in single precision where that loses nothing."""
    with np.errstate(over="ignore"):
        short = x.astype(np.float32)
    return [(s if (s == v).all() else v).tobytes() for s, v in zip(short, x, strict=True)]


def unpacked(data: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors of ``packed`` ones; the largest component is scaled to 1 first, so that squares neither vanish nor overflow."""
    x = np.array([np.frombuffer(b, np.float32 if len(b) == 4 * dim else np.float64) for b in data], np.float64).reshape(len(data), dim)
    x /= np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def pairs_above(x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.nonzero(x @ y.T >= least - 1e-9)
    # where all rows of two blocks link, their pairs' vectors would take gigabytes at once
    keep = np.empty(len(a), bool)
    for at in range(0, len(a), PAIRS):
        p, q = a[at : at + PAIRS], b[at : at + PAIRS]
        keep[at : at + PAIRS] = np.einsum("ij,ij->i", x[p], y[q]) >= least
    return a[keep], b[keep]


def meet_before(a: list[np.ndarray], b: list[np.ndarray], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether the pairs (a[p], b[q]) share one of their keys."""
    wide = max((len(k) for k in (*a, *b)), default=0)
    out = np.zeros(len(p), bool)
    if not wide or not len(p):
        return out

    def matrix(keys: list[np.ndarray], fill: int) -> np.ndarray:
        m = np.full((len(keys), wide), fill, np.int64)
        for i, k in enumerate(keys):
            m[i, : len(k)] = k
        return m

    ma, mb = matrix(a, -1), matrix(b, -2)
    step = max(1, PAIRS * 400 // (wide * wide))
    for at in range(0, len(p), step):
        out[at : at + step] = (ma[p[at : at + step]][:, :, None] == mb[q[at : at + step]][:, None, :]).any((1, 2))
    return out


def components_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n rows reaches by the links (a, b)."""
    label = np.arange(n)
    while True:
        old = label.copy()
        np.minimum.at(label, a, old[b])
        np.minimum.at(label, b, old[a])
        label = label[label]
        if (label == old).all():
            return label


def index(classes: DataFrame, trees: int) -> DataFrame:
    """(rep, g, dim, copies, vec, keys) from classes (rep, g, dim, copies, embedding): the leaves of each class as keys of tree and node."""
    spark = classes.sparkSession
    sizes = classes.groupBy("dim", "g").count().groupBy("dim").agg(F.max("count").alias("n"), F.sum("count").alias("all")).where(F.col("n") > LEAF).collect()
    forests: dict[int, tuple[int, list[np.ndarray]]] = {}
    total = sum(r["all"] for r in sizes)
    if sizes:
        some = classes.where(F.col("dim").isin([r["dim"] for r in sizes]) & (F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(max(1, total // SAMPLE))) == 0))
        sample: dict[int, list] = {}
        for r in some.select("dim", "embedding").limit(2 * SAMPLE).collect():
            sample.setdefault(r["dim"], []).append(r["embedding"])
        for r in sizes:
            x = np.array(sample.get(r["dim"], []), np.float64)
            depth = min(int(np.ceil(np.log2(r["n"] / LEAF))), int(np.log2(max(1, len(x)) / 8)) if len(x) else 0)
            if depth > 0:
                x /= np.abs(x).max(1)[:, None]
                x /= np.sqrt((x * x).sum(1))[:, None]
                forests[r["dim"]] = depth, [fitted(x, t, 1, depth, spill_of(depth)) for t in range(trees)]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                part = batch.take(pa.array(np.nonzero(dims == dim)[0]))
                data = packed(np.array(part.column(4).to_pylist(), np.float64).reshape(part.num_rows, dim))
                if dim in forests:
                    depth, cuts = forests[dim]
                    x, held = unpacked(data, dim), [[] for _ in data]
                    for t in range(trees):
                        for node, rows in descend(x, t, 1, depth, cuts[t]):
                            for i in rows.tolist():
                                held[i].append((t << TREE_SHIFT) | node)
                else:
                    held = [[1]] * len(data)
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(data, pa.binary()), pa.array(held, pa.list_(pa.int64()))], names=["rep", "g", "dim", "copies", "vec", "keys"])

    columns = "rep long, g long, dim int, copies long, vec binary"
    placed = stored(classes.select("rep", "g", "dim", "copies", "embedding").mapInArrow(assign, f"{columns}, keys array<long>"), "leaves")
    if not forests:
        return placed
    members = placed.select("rep", "g", F.explode("keys").alias("key"))
    again, most = False, None
    while True:
        large = members.groupBy("g", "key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > LARGE_LEAF)
        large = stored(large, "large-leaves")
        count, top = large.agg(F.count(F.lit(1)), F.max("size")).first()
        if not count or (most is not None and top > 0.9 * most):  # what random directions don't part is left to blocks
            break
        again, most = True, top
        members = stored(split_again(members, large, placed, count), "members")
    if not again:
        return placed
    keys = members.groupBy("rep").agg(F.array_sort(F.array_distinct(F.collect_list("key"))).alias("keys"))
    return stored(placed.drop("keys").join(keys, "rep"), "leaves")


def split_again(members: DataFrame, large: DataFrame, placed: DataFrame, count: int) -> DataFrame:
    """Members (rep, g, key) with those of the leaves ``large`` (g, key, size) dealt to leaves of trees below them."""
    few = count <= BROADCAST_LEAVES
    spill = spill_of(30)
    inside = members.join(F.broadcast(large) if few else large, ["g", "key"]).join(placed.select("rep", "dim", "vec"), "rep")
    sample = inside.where(F.pmod(F.xxhash64("rep", "key"), F.lit(1_000_000)) < F.lit(1e6 * LEAF_SAMPLE) / F.col("size"))
    mask = (1 << TREE_SHIFT) - 1

    def fit(key, rows: pd.DataFrame) -> pd.DataFrame:
        g, k = int(key[0]), int(key[1])
        x = unpacked(rows["vec"].tolist(), int(rows["dim"].iloc[0]))
        return pd.DataFrame({"g": [g], "key": [k], "cuts": [fitted(x, k >> TREE_SHIFT, k & mask, SUBTREE, spill).ravel()]})

    fits = stored(sample.select("g", "key", "dim", "vec").groupBy("g", "key").applyInPandas(fit, "g long, key long, cuts array<double>"), "subtrees")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, g, key, dim = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            order = np.lexsort((key, g))
            cut = np.nonzero(np.diff(g[order]) | np.diff(key[order]))[0] + 1
            for rows in np.split(order, cut) if len(order) else []:
                k = int(key[rows[0]])
                x = unpacked(batch.column(4).take(pa.array(rows)).to_pylist(), int(dim[rows[0]]))
                cuts = np.array(batch.column(5)[int(rows[0])].as_py()).reshape(-1, 3)
                for node, some in descend(x, k >> TREE_SHIFT, k & mask, SUBTREE, cuts):
                    found = rows[some]
                    yield pa.RecordBatch.from_arrays([pa.array(rep[found]), pa.array(g[found]), pa.array(np.full(len(found), (k & ~mask) | node))], names=["rep", "g", "key"])

    dealt = inside.select("rep", "g", "key", "dim", "vec").join(F.broadcast(fits) if few else fits, ["g", "key"])
    new = dealt.select("rep", "g", "key", "dim", "vec", "cuts").mapInArrow(assign, "rep long, g long, key long")
    return members.join(F.broadcast(large.select("g", "key")) if few else large, ["g", "key"], "left_anti").select("rep", "g", "key").unionByName(new)


def linked(placed: DataFrame, least: float) -> DataFrame:
    """(rep, others, other): how many vectors a class links with, in parts to add up (other is null), and edges (rep, other) that join
    the same components as all links between classes."""
    rows = placed.select("rep", "g", "dim", "copies", "vec", "keys", F.explode("keys").alias("key"))
    # a pair meets in its first common leaf: only the leaves before this one matter
    rows = rows.withColumn("keys", F.filter("keys", lambda k: k < F.col("key")))
    sizes = placed.select("g", F.explode("keys").alias("key")).groupBy("g", "key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > BLOCK)
    sizes = sizes.select("g", "key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(sizes, ["g", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep", "key"), "blocks").cast("int"))
    # a row of block i takes part in the comparisons (i, j) and (j, i) with i <= j
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})

    def compare(key, group: pd.DataFrame) -> pd.DataFrame:
        dim = int(group["dim"].iloc[0])
        x, rep, copies, block = unpacked(group["vec"].tolist(), dim), group["rep"].to_numpy(), group["copies"].to_numpy(), group["block"].to_numpy()
        keys = [np.asarray(k, np.int64) for k in group["keys"]]
        i, j = int(key[2]), int(key[3])
        first, second = np.nonzero(block == i)[0], np.nonzero(block == j)[0]
        a, b = pairs_above(x[first], x[second], least)
        a, b = first[a], second[b]
        once = a < b if i == j else rep[a] != rep[b]
        a, b = a[once], b[once]
        new = ~meet_before(keys, keys, a, b)
        a, b = a[new], b[new]
        others = np.bincount(a, copies[b], len(rep)) + np.bincount(b, copies[a], len(rep))
        root = components_of(len(rep), a, b)
        edge, seen = np.nonzero(root != np.arange(len(rep)))[0], np.nonzero(others)[0]
        ids = pd.array([pd.NA] * len(seen) + rep[root[edge]].tolist(), "Int64")
        return pd.DataFrame({"rep": np.concatenate([rep[seen], rep[edge]]), "others": np.concatenate([others[seen], np.zeros(len(edge))]).astype(np.int64), "other": ids})

    dealt = dealt.select("g", "key", "i", "j", "rep", "dim", "copies", "vec", "block", "keys")
    return stored(dealt.groupBy("g", "key", "i", "j").applyInPandas(compare, "rep long, others long, other long"), "vector-links")


def near_vectors(rows: DataFrame, least: float = MIN_COSINE, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", trees: int = TREES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row; other columns aren't read."""
    base = rows.select(quoted(id_col).alias("id"), quoted(label).cast("string").alias("label"), F.transform(quoted(vector), lambda x: x.cast("double")).alias("embedding"))
    # a zero of either sign is one value
    base = base.withColumn("embedding", F.transform("embedding", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)))
    base = base.withColumn("ok", usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("id").isNotNull())
    base = base.withColumn("same", F.when(F.col("ok"), F.sha2(F.concat_ws(",", F.col("label"), F.transform("embedding", lambda x: x.cast("string"))), 256)))
    classes = base.where("ok").groupBy("same").agg(F.min("id").cast("long").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    # vectors meet within a label and a length
    classes = stored(classes.withColumns({"dim": F.size("embedding"), "g": F.xxhash64("label", F.size("embedding"))}), "vector-classes")
    found = linked(index(classes, trees), least)
    counts = found.where("other is null").groupBy("rep").agg(F.sum("others").alias("others"))
    parts = connected_components(found.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    named = classes.select("same", "rep", "copies").join(counts, "rep", "left").join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left")
    named = named.select("same", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = base.select("id", "same").join(named, "same", "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(quoted(id_col) == F.col("component_id"), F.lit(False)))


def op6_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


SQL = r"""
WITH RECURSIVE e AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM e x JOIN e y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.v, y.v) >= 0.93
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a
), n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a
)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON vec_id = c.a LEFT JOIN n ON vec_id = n.a
"""
