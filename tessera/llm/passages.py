r"""Operator 2: substring dedup by collinear chaining.

Each document gives seeds: of every window of WINDOW consecutive k-mers of words the one with the smallest hash, so that equal
runs of K + WINDOW - 1 words share a seed. Of the documents that hold a seed the one with the smallest id leads, and each other
document's place is joined to the leader's: as many rows as places, however many documents share a passage. Per pair of
documents the matches are chained in order with a cost for gaps, through a Fenwick tree of prefix maxima, and chains are aligned
word by word: anchors, the edits between them, and extension at both ends give fuzzy passages with their identity. A chain of which
too little is equal is cut at its gaps, down to single equal runs, and the parts that are equal enough are taken.

A passage may be made of pieces that different earlier documents hold, too short to be passages there. Runs of shared seeds with
different leaders are therefore seeds once more, and led by the first document that holds the whole run.

A passage that several documents hold is found in each of them, at every place, against its leader, the copy that stays.

Defined cases: null, empty and short texts have no seeds and no passages; words are runs without ASCII spaces, A-Z lower-cased;
repeated rows are one document; passages repeated only inside one document aren't reported; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import small_batches, stored, table

K, WINDOW = 8, 12
#: Words that a passage spans at least, and the least share of them that are aligned equal. Passages of 50 words and more are
#: meant; some less are taken, since the words at their ends may carry other punctuation.
MIN_WORDS, MIN_IDENTITY = 45, 0.8
#: Cost of a word of gap on either side, gap at which a chain ends, and words that an extension looks ahead over edits.
GAP_COST, MAX_GAP, REACH = 0.1, 40, 20
BROADCAST_IDS, CACHED_WORDS, CACHED_TEXTS, SLICE = 2_000_000, 1 << 17, 16, 256


class _Words(dict):
    """Hashes of words, kept while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def word_hashes(text: str | None, words: _Words) -> np.ndarray:
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))


def seeds(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of a document's seeds."""
    n = len(h) - K + 1
    if n < 1:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        g = np.zeros(n, np.uint64)
        for i in range(K):
            g = g * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
            g ^= g >> np.uint64(29)
        g *= np.uint64(0xBF58476D1CE4E5B9)
        g ^= g >> np.uint64(32)
    if n <= WINDOW:
        at = np.array([int(g.argmin())])
    else:
        view = np.lib.stride_tricks.sliding_window_view(g, WINDOW)
        at = np.unique(view.argmin(1) + np.arange(len(view)))
    return g[at], at


def numbered(g: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of seeds that a document holds before: the second, third, ... place of a seed is a seed of its own as well, so that
    texts with inner repeats align, too."""
    order = np.argsort(g, kind="stable")
    new = np.ones(len(g), bool)
    new[1:] = np.diff(g[order]) != 0
    nth = np.empty(len(g), np.uint64)
    nth[order] = np.arange(len(g)) - np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
    later = nth > 0
    with np.errstate(over="ignore"):
        return g[later] + nth[later] * np.uint64(0xD6E8FEB86659FD93), at[later]


def seed_table(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for whole in batches:
            for low in range(0, whole.num_rows, SLICE):
                hs, ds, ps = [], [], []
                for i, t in zip(*(c.to_pylist() for c in whole.slice(low, SLICE).columns), strict=True):
                    plain = seeds(word_hashes(t, words))
                    for g, at in (plain, numbered(*plain)):
                        hs.append(g.view(np.int64))
                        ds.append(np.full(len(g), i, np.int64))
                        ps.append(at.astype(np.int32))
                if hs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (hs, ds, ps)], names=["seed", "doc", "place"])

    rows = docs.where(F.col(id_col).isNotNull() & F.col(text).isNotNull())
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "seed long, doc long, place int")


class Fenwick:
    """Prefix maxima of (score, index) over ranks."""

    def __init__(self, n: int) -> None:
        self.best: list[tuple[float, int]] = [(-1.0, -1)] * (n + 1)

    def put(self, rank: int, value: tuple[float, int]) -> None:
        rank += 1
        while rank < len(self.best):
            if value > self.best[rank]:
                self.best[rank] = value
            rank += rank & -rank

    def get(self, rank: int) -> tuple[float, int]:
        """The best of all ranks below ``rank``."""
        found = (-1.0, -1)
        while rank > 0:
            if self.best[rank] > found:
                found = self.best[rank]
            rank -= rank & -rank
        return found


def segments(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int]]:
    """Matches on one diagonal that touch or lie close merge to (x, y, length)."""
    order = np.lexsort((x, y - x))
    x, y = x[order], y[order]
    new = np.ones(len(x), bool)
    new[1:] = (np.diff(y - x) != 0) | (np.diff(x) > K)
    first = np.nonzero(new)[0]
    last = np.append(first[1:], len(x)) - 1
    return sorted(zip(x[first].tolist(), y[first].tolist(), (x[last] - x[first] + K).tolist(), strict=True))


def chains(x: np.ndarray, y: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Chains of segments in order on both sides, best first; each segment is in one chain.

    A segment's score is its length plus the best score before it, less the cost of the gap: f(i) + cost * (end of i) is what the
    tree keeps by the end on the second side, so the best one before is a prefix maximum. Gaps beyond MAX_GAP start a new chain."""
    todo, out = segments(x, y), []
    ends = sorted({b + n for _, b, n in todo})
    tree = Fenwick(len(ends))
    score, back = [0.0] * len(todo), [-1] * len(todo)
    waiting = sorted(range(len(todo)), key=lambda i: todo[i][0] + todo[i][2])
    w = 0
    for i, (a, b, n) in enumerate(todo):
        while w < len(waiting) and todo[waiting[w]][0] + todo[waiting[w]][2] <= a + K - 1:
            j = waiting[w]
            if j < i:
                p, q, m = todo[j]
                tree.put(bisect_right(ends, q + m) - 1, (score[j] + GAP_COST * (p + m + q + m), j))
            w += 1
        value, j = tree.get(bisect_right(ends, b + K - 1))
        score[i] = float(n)
        if j >= 0:
            p, q, m = todo[j]
            gain = value - GAP_COST * (a + b)
            if gain > 0 and a - (p + m) <= MAX_GAP and b - (q + m) <= MAX_GAP and todo[i][1] > q:
                score[i] += gain
                back[i] = j
    used = [False] * len(todo)
    for i in sorted(range(len(todo)), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(todo[i])
            i = back[i]
        if chain:
            out.append(chain[::-1])
    return out


def _equal_words(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two short runs."""
    if not len(a) or not len(b):
        return 0
    if len(a) == len(b) and (same := int((a == b).sum())) >= len(a) - 2:
        return same
    row = np.zeros(len(b) + 1, np.int32)
    for w in a:
        # a match extends the best before it; the running maximum carries values over
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(b == w, row[:-1] + 1, 0)))
    return int(row[-1])


def _threes(h: np.ndarray) -> np.ndarray:
    """Hashes of three words each."""
    if len(h) < 3:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        return (h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1]) * np.uint64(0xBF58476D1CE4E5B9) + h[2:]


def _run(a: np.ndarray, b: np.ndarray) -> int:
    """How many words two runs have in common from their starts."""
    n, at = min(len(a), len(b)), 0
    while at < n:
        m = min(64, n - at)
        differ = np.nonzero(a[at : at + m] != b[at : at + m])[0]
        if len(differ):
            return at + int(differ[0])
        at += m
    return n


def _steps(a: np.ndarray, b: np.ndarray) -> tuple[list[tuple[int, int, int]], int, int]:
    """How far two runs go on alike from their starts: equal runs (place, place there, words), then over the fewest edits after which
    more words are equal again than were edited; and the places reached."""
    i = j = 0
    out: list[tuple[int, int, int]] = []
    threes, there = _threes(a), _threes(b)
    while True:
        run = _run(a[i:], b[j:])
        if run:
            out.append((i, j, run))
        i, j = i + run, j + run
        p, q = np.nonzero(threes[i : i + REACH, None] == there[None, j : j + REACH])
        if not len(p):
            return out, i, j
        best = int((p + q).argmin())
        p, q = int(p[best]), int(q[best])
        if _run(a[i + p : i + p + REACH], b[j + q : j + q + REACH]) < max(p, q) + 2:
            return out, i, j
        i, j = i + p, j + q


def _extended(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """How far two runs go on alike from their starts, and how many words are equal there."""
    runs, i, j = _steps(a, b)
    return i, j, sum(n for *_, n in runs)


def aligned(a: np.ndarray, b: np.ndarray, chain: list[tuple[int, int, int]]) -> tuple[int, int, int, int, int]:
    """(start, stop, start there, stop there, equal words) of a chain aligned on the words of both documents."""
    x, y, n = chain[0]
    equal, x2, y2 = int((a[x : x + n] == b[y : y + n]).sum()), x + n, y + n
    for p, q, m in chain[1:]:
        over = max(0, x2 - p, y2 - q)
        p, q, m = p + over, q + over, m - over
        if m <= 0:
            continue
        equal += _equal_words(a[x2:p], b[y2:q]) + int((a[p : p + m] == b[q : q + m]).sum())
        x2, y2 = p + m, q + m
    on, on_there, more = _extended(a[x2:], b[y2:])
    back, back_there, before = _extended(a[:x][::-1], b[:y][::-1])
    return x - back, x2 + on, y - back_there, y2 + on_there, equal + more + before


def _backward(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """Equal runs (place, place there, words), in order, by which two runs go on alike backwards from their stops."""
    return [(len(a) - i - n, len(b) - j - n, n) for i, j, n in reversed(_steps(a[::-1], b[::-1])[0])]


def equal_runs(a: np.ndarray, b: np.ndarray, chain: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The equal runs (place, place there, words) of a chain: its segments, and what extends them into the gaps and at both ends."""
    x, y, n = chain[0]
    out = [*_backward(a[:x], b[:y]), (x, y, n)]
    x2, y2 = x + n, y + n
    for p, q, m in chain[1:]:
        over = max(0, x2 - p, y2 - q)
        p, q, m = p + over, q + over, m - over
        if m <= 0:
            continue
        on, i, j = _steps(a[x2:p], b[y2:q])
        out += [(x2 + u, y2 + v, w) for u, v, w in on]
        x2, y2 = x2 + i, y2 + j
        out += [(x2 + u, y2 + v, w) for u, v, w in _backward(a[x2:p], b[y2:q])]
        out.append((p, q, m))
        x2, y2 = p + m, q + m
    return out + [(x2 + u, y2 + v, w) for u, v, w in _steps(a[x2:], b[y2:])[0]]


def alike(a: np.ndarray, b: np.ndarray, chain: list[tuple[int, int, int]], min_words: int, min_identity: float) -> list[tuple[int, int, int, int, int]]:
    """Passages (start, stop, start there, stop there, equal words) of a chain: the whole one where enough of it is equal, else those
    of its parts from one equal run to another that are long and equal enough. A part inside another one isn't reported, nor one that
    others cover, so that every equal run of a part that passes is in a passage."""
    whole = aligned(a, b, chain)
    x, x2, y, y2, equal = whole
    if equal >= min_identity * max(x2 - x, y2 - y):
        return [whole] if min(x2 - x, y2 - y) >= min_words else []
    runs = np.array(equal_runs(a, b, chain), np.int64)
    starts, stops, n = runs[:, :2], runs[:, :2] + runs[:, 2:], runs[:, 2]
    between = np.array([_equal_words(a[u:p], b[v:q]) for (u, v), (p, q) in zip(stops[:-1].tolist(), starts[1:].tolist(), strict=True)], np.int64)
    lost = (starts[1:] - stops[:-1]).max(1, initial=0)
    # what a part has beyond the least identity is a difference of sums: up to the end of its last run, from the start of its first
    value = (1 - min_identity) * n
    gaps = np.append(0.0, between - min_identity * lost)
    after = np.cumsum(value + gaps)
    before = after - value
    furthest = np.maximum.accumulate(after[::-1])[::-1]
    last = np.searchsorted(-furthest, -(before - 1e-9), "right") - 1  # the last run to which a part from each run may go
    sums = np.cumsum(n + np.append(0, between))
    found: list[tuple[int, int]] = []
    for i, j in enumerate(last.tolist()):
        if j < i or (stops[j] - starts[i]).min() < min_words or (found and j <= found[-1][1]):
            continue
        while len(found) > 1 and found[-2][1] >= i - 1:
            found.pop()  # the one before it and this one cover it
        found.append((i, j))
    return [(int(starts[i, 0]), int(stops[j, 0]), int(starts[i, 1]), int(stops[j, 1]), int(sums[j] - sums[i] + n[i])) for i, j in found]


PASSAGE = "doc_id long, start int, stop int, other_id long, other_start int, other_stop int, n_words int, n_equal int"


def mixed_runs(seed: np.ndarray, other: np.ndarray, place: np.ndarray, there: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, last place) of runs of a document's shared seeds, in order of place, that no leader holds as a whole: their seeds
    have different leaders, or places far apart in one. Every span is taken that the seeds of an equal passage of ``min_words`` may
    have, up to the first that such a passage has whole."""
    # the numbered seeds of a place come beside its plain one; one seed a place is enough here
    at = np.unique(place, return_index=True)[1]
    seed, other, place, there = (c[at] for c in (seed.view(np.uint64), other, place.astype(np.int64), there.astype(np.int64)))
    n = len(place)
    cut = (np.diff(other) != 0) | (np.abs(np.diff(there - place)) > MAX_GAP)
    cuts = np.append(0, np.cumsum(cut))
    far = np.append(0, np.cumsum(np.diff(place) > MAX_GAP))
    least = min_words - 2 * (WINDOW - 1)
    hashes, firsts, lasts = [], [], []
    h, open_ = seed.copy(), np.arange(n)
    step = 0
    while len(open_):
        step += 1
        open_ = open_[open_ + step < n]
        open_ = open_[far[open_ + step] == far[open_]]
        end = open_ + step
        with np.errstate(over="ignore"):
            mixed = (h[open_] ^ (h[open_] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + seed[end]
        h[open_] = mixed
        span = place[end] + K - place[open_]
        take = (span >= least) & (cuts[end] > cuts[open_])
        hashes.append(mixed[take])
        firsts.append(place[open_[take]])
        lasts.append(place[end[take]])
        open_ = open_[span < min_words]
    empty = np.empty(0, np.int64)
    return np.concatenate([empty.view(np.uint64), *hashes]), np.concatenate([empty, *firsts]), np.concatenate([empty, *lasts])


def run_matches(shared: DataFrame, min_words: int) -> DataFrame:
    """Matches (doc, other, place, there) at both ends of runs of shared seeds: each document's run is joined to that of the document
    with the smallest id that holds it, so that passages made of pieces with different leaders meet as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        current = None

        def close() -> pa.RecordBatch:
            h, first, last = mixed_runs(*(np.concatenate(c) for c in zip(*held, strict=True)), min_words)
            columns = [h.view(np.int64), np.full(len(h), current, np.int64), first.astype(np.int32), last.astype(np.int32)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["run", "doc", "place", "last"])

        for batch in batches:
            seed, doc, other, place, there = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cuts = (np.nonzero(np.diff(doc) != 0)[0] + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(doc)], strict=True):
                if a == b:
                    continue
                if held and int(doc[a]) != current:
                    yield close()
                    held = []
                current = int(doc[a])
                held.append([c[a:b] for c in (seed, other, place, there)])
        if held:
            yield close()

    # of a place's seeds the plain one comes first, since its leader has the smallest id
    dealt = shared.repartition("doc").sortWithinPartitions("doc", "place", "other", "there")
    runs = stored(dealt.mapInArrow(run, "run long, doc long, place int, last int"), "runs")
    leaders = runs.groupBy("run").agg(F.min(F.struct("doc", "place", "last")).alias("m"), F.max("doc").alias("to")).where("m.doc < to")
    both = runs.join(leaders, "run").where("doc <> m.doc")
    ends = F.explode(F.array(F.struct("place", F.col("m.place").alias("there")), F.struct(F.col("last").alias("place"), F.col("m.last").alias("there"))))
    return both.select("doc", F.col("m.doc").alias("other"), ends.alias("e")).select("doc", "other", "e.place", "e.there").distinct()


def passages(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY) -> DataFrame:
    """Passages (places in words, stop exclusive) that a document shares with another one, the leader that holds them first by id."""
    small_batches(docs.sparkSession)
    found = stored(seed_table(docs, id_col, text), "seeds")
    leaders = found.groupBy("seed").agg(F.min(F.struct("doc", "place")).alias("m"), F.max("doc").alias("last")).where("m.doc < last")
    leaders = leaders.select("seed", F.col("m.doc").alias("other"), F.col("m.place").alias("there"))
    shared = stored(found.join(leaders, "seed").select("seed", "doc", "other", "place", "there"), "shared")
    plain = shared.where("doc <> other").select("doc", "other", "place", "there", F.lit(False).alias("extra"))
    matches = plain.unionByName(run_matches(shared, min_words).withColumn("extra", F.lit(True)))

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        pair: tuple | None = None
        out: list[tuple] = []

        def close() -> None:
            place, there, extra = (np.concatenate(x).astype(np.int64) for x in zip(*held, strict=True))
            # extension may add some words at either end, and covers what lies between two seeds
            least = min_words - 2 * (K + WINDOW)
            for with_runs in {False, bool(extra.any())}:
                x, y = (place, there) if with_runs else (place[extra == 0], there[extra == 0])
                kept = [[v for s in c for v in s] for c in chains(x, y) if c[-1][0] + c[-1][2] - c[0][0] >= least and sum(n for *_, n in c) > K] if len(x) else []
                if kept:
                    out.append((*pair, with_runs, kept))

        schema = pa.schema([("doc", pa.int64()), ("other", pa.int64()), ("extra", pa.bool_()), ("chains", pa.list_(pa.list_(pa.int32())))])
        for batch in batches:
            doc, other, place, there, extra = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cuts = np.nonzero((np.diff(doc) != 0) | (np.diff(other) != 0))[0] + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(doc)], strict=True):
                if a == b:
                    continue
                key = (int(doc[a]), int(other[a]))
                if key != pair:
                    if pair is not None:
                        close()
                    held, pair = [], key
                held.append((place[a:b], there[a:b], extra[a:b]))
                if len(out) >= 1000 or (out and len(out[-1][3]) >= 1000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out.clear()
        if pair is not None:
            close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    dealt = matches.repartition("doc", "other").sortWithinPartitions("doc", "other", "place", "there")
    chained = stored(dealt.mapInArrow(chain, "doc long, other long, extra boolean, chains array<array<int>>"), "chains")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, kept = _Words(), {}
        schema = pa.schema([(n, pa.int64() if n.endswith("_id") else pa.int32()) for n in ("doc_id", "start", "stop", "other_id", "other_start", "other_stop", "n_words", "n_equal")] + [("extra", pa.bool_())])

        def of(key: int, text: str) -> np.ndarray:
            if key not in kept:
                if len(kept) >= CACHED_TEXTS:
                    kept.clear()
                kept[key] = word_hashes(text, words)
            return kept[key]

        for whole in batches:
            for low in range(0, whole.num_rows, SLICE):
                out = []
                for doc, other, extra, flats, s, t in zip(*(c.to_pylist() for c in whole.slice(low, SLICE).columns), strict=True):
                    a, b = of(doc, s), of(other, t)
                    for flat in flats:
                        c = list(zip(flat[::3], flat[1::3], flat[2::3], strict=True))
                        for x, x2, y, y2, equal in alike(a, b, c, min_words, min_identity):
                            out.append((doc, x, x2, other, y, y2, max(x2 - x, y2 - y), equal, extra))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    ids = chained.select(F.col("doc").alias("id")).union(chained.select("other")).distinct()
    few = chained.count() * 2 <= BROADCAST_IDS
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).join(F.broadcast(ids) if few else ids, "id", "left_semi")
    # the leader's text joins last, so that no shuffle carries it once for each document
    both = chained.join(texts.select(F.col("id").alias("doc"), F.col("text").alias("s")), "doc").join(texts.select(F.col("id").alias("other"), F.col("text").alias("t")), "other")
    # a repeated row brings its text, and so its passages, again
    found = stored(both.select("doc", "other", "extra", "chains", "s", "t").mapInArrow(align, f"{PASSAGE}, extra boolean").distinct(), "passages")
    # the leader of a run isn't reported where the seeds' own leaders hold its passage
    led = found.where("not extra").drop("extra")
    held = led.select("doc_id", F.col("start").alias("s"), F.col("stop").alias("e"))
    more = found.where("extra").drop("extra").join(held, "doc_id", "left").groupBy(*led.columns).agg(F.max(F.coalesce(F.expr("s <= start and stop <= e"), F.lit(False))).alias("known"))
    return led.unionByName(more.where("not known").drop("known"))


def op2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "documents"))
