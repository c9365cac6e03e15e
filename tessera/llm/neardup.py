r"""Operator 3: near-duplicates by SetSketch registers.

A register holds an exponentially spaced, truncated minimum of a document's shingle hashes: floor(1 - log_b x) of the
smallest exponential variate x, clamped to a byte. Registers merge by maximum, and two sets share one with a probability
that follows their similarity. Documents with equal sets form a class first; classes with equal bands of registers are
candidates; the likelihood of all registers together, given the known set sizes, estimates the similarity; what may reach
the threshold is confirmed on the full sets.

Inside a bucket no pairs of all members are made. First each member meets the bucket's leader, and links are joined to
components. Only members of different components of a bucket may still add a link: they meet in blocks of bounded size,
where sketches are compared as arrays. Texts follow only for the rows of a block that have a promising pair there; such pairs are
confirmed on the full sets, and only links that join components leave the task. A pair meets in the first band that it shares.

Defined cases: null or empty texts, and those of spaces only, have an empty set and link with nothing; rows without an id are
returned without a component and aren't kept; repeated rows are copies of a class and all returned; a long text is taken whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import connected_components, join_unique, small_batches, stored, table

#: BANDS bands of BAND_ROWS registers. At similarity 0.8 all bands differ with a probability below 2e-5, at 0.85 below 5e-7.
BANDS, BAND_ROWS = 26, 5
REGISTERS = BANDS * BAND_ROWS
#: Base and rate of the exponential scale: 254 steps from sets of one to sets of some ten millions.
BASE, RATE, TOP = 1.08, 20.0, 254
#: An estimate may fall below the threshold by this and the pair is still confirmed (about 5 standard deviations).
MARGIN = 0.18
#: Rows of a block: members of a bucket meet in pairs of blocks.
BLOCK = 512
#: Ids of documents that a task filters by are broadcast up to this number (8 bytes each), else joined by shuffle.
BROADCAST_IDS = 2_000_000
CACHED_WORDS, CACHED_SETS, SLICE = 1 << 17, 64, 256

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


class _Words(dict):
    """Hashes of words, kept while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(text: str | None, width: int, words: _Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles: A-Z lower-cased, words between the six ASCII spaces."""
    if not text:
        return np.empty(0, np.uint64)
    # bytes.lower and bytes.split know ASCII letters and just these six spaces
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    n = min(width, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            out = _scramble(out * _MIX[0] + h[i : len(h) - n + 1 + i])
    return np.unique(out)


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 63, REGISTERS, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, REGISTERS, np.uint64)


def registers(hashes: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """The sketch of a set: one byte for each register. Sketches of parts merge by maximum."""
    least = np.full(len(mul), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 2048):
            part = hashes[at : at + 2048]
            np.minimum(least, (mul[:, None] * part[None, :] + add[:, None]).min(axis=1), out=least)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(x) / log(BASE)) + 64, 0, TOP + 1).astype(np.uint8)


SKETCH_SCHEMA = "doc_id long, n long, h1 long, h2 long, sketch binary"


def sketched(docs: DataFrame, width: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, h1, h2, sketch) for each row: size and 128-bit digest of the shingle set, and its registers (null if empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (mul, add) = _Words(), _multipliers()
        last: tuple = (None, None)
        for whole in batches:
            for low in range(0, whole.num_rows, SLICE):  # few texts at a time as Python objects
                batch = whole.slice(low, SLICE)
                n, h1, h2, sketch = [], [], [], []
                for t in batch.column(1).to_pylist():
                    if t != last[0] or t is None:  # copies often lie together
                        h = shingle_hashes(t, width, words)
                        with np.errstate(over="ignore"):
                            sums = (int(h.sum(dtype=np.uint64).astype(np.int64)), int(_scramble(h * _MIX[1]).sum(dtype=np.uint64).astype(np.int64)))
                        last = (t, (len(h), *sums, registers(h, mul, add).tobytes() if len(h) else None))
                    for out, x in zip((n, h1, h2, sketch), last[1], strict=True):
                        out.append(x)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sketch, pa.binary())],
                    names=["doc_id", "n", "h1", "h2", "sketch"],
                )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SKETCH_SCHEMA)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / log(BASE)


def likely_similarity(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of pairs from registers (k, m) and known set sizes, on a grid of hundredths."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = a.shape[1] - more - less
    u = (na / (na + nb))[:, None]
    v, grid = 1 - u, np.linspace(0, 1, 101)[None, :]
    up, down = _p(u - v * grid), _p(v - u * grid)
    tie = np.clip(1 - up - down, 1e-12, 1)
    fit = more * np.log(np.maximum(up, 1e-12)) + less * np.log(np.maximum(down, 1e-12)) + same * np.log(tie)
    # a similarity can't exceed the ratio of the sizes
    fit = np.where(grid <= np.minimum(na, nb)[:, None] / np.maximum(na, nb)[:, None] + 0.005, fit, -np.inf)
    return grid[0][fit.argmax(1)]


def promising(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose estimated similarity comes near the threshold."""
    least = percent / 100 - MARGIN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            sketches = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3)]
            sizes = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in (4, 5)]
            good = likely_similarity(*sketches, *sizes) >= least
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good))

    of = lambda x: classes.select(F.col("rep").alias(x), F.col("sketch").alias(f"s{x}"), F.col("n").alias(f"n{x}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return both.select("a", "b", "sa", "sb", "na", "nb").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets reach the threshold. ``texts``: (doc_id, text), one row for each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sets = _Words(), {}

        def of(key: int, text: str) -> np.ndarray:
            if key not in sets:
                if len(sets) >= CACHED_SETS:
                    sets.clear()
                sets[key] = shingle_hashes(text, width, words)
            return sets[key]

        for batch in (x.slice(low, SLICE) for x in batches for low in range(0, x.num_rows, SLICE)):
            a, b, ta, tb = (c.to_pylist() for c in batch.columns)
            good = []
            for x, y, s, t in zip(a, b, ta, tb, strict=True):
                p, q = of(x, s), of(y, t)
                both = len(np.intersect1d(p, q, assume_unique=True))
                good.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    of = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"t{x}"))
    # b is the leader: its text joins last, so no shuffle carries it once for each member
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def texts_of(docs: DataFrame, pairs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(doc_id, text) of the ids in ``pairs``, one row for each id."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    if pairs.count() * 2 <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).join(ids, "doc_id", "left_semi")


def _shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, by products of their incidence with parts of the universe."""
    out = np.zeros((len(a), len(b)), np.float32)
    flat = np.concatenate([*a, *b])
    row = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    universe, col = np.unique(flat, return_inverse=True)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for low in range(0, len(universe), 4096):
        lo, hi = np.searchsorted(col, [low, low + 4096])
        held = np.zeros((len(a) + len(b), 4096), np.float32)
        held[row[lo:hi], col[lo:hi] - low] = 1
        out += held[: len(a)] @ held[len(a) :].T
    return out.astype(np.int64)


class _Block:
    """Rows of two parts of a bucket (of one part, if both are the same) that meet each other."""

    def __init__(self, rows: list[tuple], i: int, j: int) -> None:
        self.rep = np.array([r[0] for r in rows], np.int64)
        self.component = np.array([r[1] for r in rows], np.int64)
        self.n = np.array([r[2] for r in rows], np.float64)
        self.band = rows[0][3]
        part = np.array([r[4] for r in rows])
        self.sketch = np.frombuffer(b"".join(r[5] for r in rows), np.uint8).reshape(len(rows), REGISTERS)
        self.texts = [r[6] for r in rows] if len(rows[0]) > 6 else []
        self.left, self.right, self.same = np.nonzero(part == i)[0], np.nonzero(part == j)[0], i == j

    def candidates(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of different components that first meet in this band and whose estimated similarity comes near the threshold."""
        least = percent / 100 - MARGIN
        y = self.right
        for at in range(0, len(self.left), 32):
            x = self.left[at : at + 32]
            equal = self.sketch[x][:, None, :] == self.sketch[y][None, :, :]
            n1, n2 = self.n[x][:, None], self.n[y][None, :]
            good = self.component[x][:, None] != self.component[y][None, :]
            good &= (100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)) & (equal.sum(2) >= least * REGISTERS - 1)
            if self.same:
                good &= x[:, None] < y[None, :]
            p, q = np.nonzero(good)
            if len(p):
                first = equal[p, q].reshape(len(p), BANDS, BAND_ROWS).all(2).argmax(1)
                p, q = p[first == self.band], q[first == self.band]
            for low in range(0, len(p), 4096):
                a, b = x[p[low : low + 4096]], y[q[low : low + 4096]]
                near = likely_similarity(self.sketch[a], self.sketch[b], self.n[a], self.n[b]) >= least
                if near.any():
                    yield a[near], b[near]

    def links(self, width: int, percent: int, words: _Words) -> Iterator[tuple[int, int]]:
        """Confirmed links, only as many as join the components that they reach."""
        found = list(self.candidates(percent))
        if not found:
            return
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        sets = {int(k): shingle_hashes(self.texts[k], width, words) for k in np.unique(np.concatenate([a, b]))}
        if len(a) <= 256:
            both = np.array([len(np.intersect1d(sets[p], sets[q], assume_unique=True)) for p, q in zip(a.tolist(), b.tolist(), strict=True)])
        else:
            rows, cols = np.unique(a), np.unique(b)
            table = _shared([sets[int(k)] for k in rows], [sets[int(k)] for k in cols])
            both = table[np.searchsorted(rows, a), np.searchsorted(cols, b)]
        true = 100 * both >= percent * (self.n[a] + self.n[b] - both)
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while root.get(c, c) != c:
                c = root[c]
            return c

        for p, q in zip(a[true].tolist(), b[true].tolist(), strict=True):
            r, t = find(int(self.component[p])), find(int(self.component[q]))
            if r != t:
                root[max(r, t)] = min(r, t)
                yield int(self.rep[p]), int(self.rep[q])


_ROW = ("key", "i", "j", "rep", "component", "n", "band", "part", "sketch")


def _each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """((key, i, j), rows) of sorted batches whose first three columns are key, i, j."""
    held, at = [], None
    for whole in batches:
        for low in range(0, whole.num_rows, SLICE):
            for key, i, j, *row in zip(*(c.to_pylist() for c in whole.slice(low, SLICE).columns), strict=True):
                if (key, i, j) != at:
                    if at is not None:
                        yield at, held
                    held, at = [], (key, i, j)
                held.append(tuple(row))
    if at is not None:
        yield at, held


def block_candidates(rows: DataFrame, percent: int) -> DataFrame:
    """The rows (key, i, j, rep, component, n, band, part, sketch) of blocks that have a promising pair there, once each."""
    columns = "key long, i int, j int, rep long, component long, n long, band int, part int, sketch binary"
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, i, j), held in _each_block(batches):
            found = [x for pair in _Block(held, i, j).candidates(percent) for x in pair] if len(held) > 1 else []
            if found:
                some = [(key, i, j, *held[k]) for k in np.unique(np.concatenate(found)).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names=list(_ROW))

    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rep")
    return dealt.select(*_ROW).mapInArrow(run, columns)


def block_links(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) inside buckets between different components, from rows of ``block_candidates`` with their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for (_, i, j), held in _each_block(batches):
            links = list(_Block(held, i, j).links(width, percent, words)) if len(held) > 1 else []
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rep")
    return dealt.select(*_ROW, "text").mapInArrow(run, "a long, b long")


def near_links(docs: DataFrame, classes: DataFrame, width: int, percent: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Links (a, b) between classes that join the same components as the links of all candidates would.

    ``classes``: (rep, n, sketch) with a unique rep whose text docs hold."""
    bands = classes.select("rep", "n", "sketch", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"))
    bands = bands.select("rep", "band", F.xxhash64(F.col("band"), F.expr(f"substring(sketch, band * {BAND_ROWS} + 1, {BAND_ROWS})")).alias("key"))
    order = F.struct(F.xxhash64("rep").alias("o"), F.col("rep").alias("leader"))
    leaders = bands.groupBy("key").agg(F.min(order).alias("m"), F.count(F.lit(1)).alias("size")).where("size > 1")
    leaders = stored(leaders.select("key", F.col("m.leader").alias("leader")), "leaders")
    bands = stored(bands, "all-bands")
    bands = stored(join_unique(bands, leaders, "key", bands.count()), "bands")
    # each member meets its buckets' leaders
    pairs = stored(bands.where("rep <> leader").select(F.col("rep").alias("a"), F.col("leader").alias("b")).distinct(), "pairs")
    near = stored(promising(pairs, classes, percent), "near")
    links = stored(confirmed(near, texts_of(docs, near, id_col, text), width, percent), "links")
    parts = connected_components(links)
    # members of different components of a bucket meet in blocks
    named = bands.select("rep", "band", "key").join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left")
    named = stored(named.withColumn("component", F.coalesce("component", "rep")), "named")
    mixed = named.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.count(F.lit(1)).alias("size")).where("c1 <> c2")
    mixed = stored(mixed.select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("parts")), "mixed")
    rows = join_unique(named, mixed, "key", named.count()).withColumn("part", F.pmod(F.xxhash64("rep", "key"), "parts").cast("int"))
    rows = stored(rows.join(classes.select("rep", "n", "sketch"), "rep").select("key", "rep", "component", "n", "band", "part", "sketch", "parts"), "open")
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "rep", "component", "n", "band", "part", "sketch")
    # sketches meet first; texts go only where they are asked for
    asked = stored(block_candidates(dealt, percent), "asked")
    whole = asked.join(texts_of(docs, asked.select(F.col("rep").alias("a"), F.col("rep").alias("b")), id_col, text).select(F.col("doc_id").alias("rep"), "text"), "rep")
    return links.unionByName(stored(block_links(whole, width, percent), "block-links"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, kept) for each row: class_id is the smallest id with the same set, component_id the
    smallest id reachable by links of a similarity of at least ``percent`` hundredths, kept whether that is the row's own id."""
    small_batches(docs.sparkSession)
    rows = stored(sketched(docs, width, id_col, text), "sketches")
    classes = rows.where("n > 0 and doc_id is not null").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"))
    classes = stored(classes, "classes")
    links = near_links(docs, classes, width, percent, id_col, text)
    parts = connected_components(links)
    named = classes.join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left")
    named = named.select("n", "h1", "h2", "rep", F.coalesce("component", "rep").alias("component"))
    out = rows.select("doc_id", "n", "h1", "h2").join(named, ["n", "h1", "h2"], "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("class_id"), F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id; of rows that repeat its id any one stays."""
    kept = near_duplicates(docs).where("kept").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 1), lambda p: ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2]) END) AS s
    FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), i AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents JOIN c ON doc_id = a LEFT JOIN n USING (doc_id)
"""
