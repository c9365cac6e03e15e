r"""Operator 1: SentencePiece encoding and decoding by a relational lattice.

A text is cut into units (a run of spaces and what follows it) over which no piece reaches, so units are segmented each on
their own. For the frequent units of the corpus: all substrings of a bounded length are exploded and joined to the
table of pieces by equality, the edges are grouped by unit, and a higher-order aggregate folds them into pieces. A unigram
model is folded by Viterbi. A BPE model (as is the public one here) isn't segmented rightly by Viterbi: its scores are
ranks of merges, so the lattice is folded by merging the best adjacent edge again and again.

Units are frequent if they occur at least as often as a threshold that keeps them under HOT_UNITS, a bound that is proven
before they are broadcast. Every rarer unit (some 7 percent of the words of prose) is encoded where it stands by the same
lattice and fold in Arrow batches, since a relational pass over all distinct units and the shuffle of all words of all
documents exceed the limits; units longer than LONG_UNIT go that way too, with a heap in place of the fold's scan.

Defined cases: null gives null ids, an empty text no ids; U+2581 in a text decodes to a space, as in the library; bytes of
unknown characters fall back to byte pieces; very long texts and units are taken whole; repeated rows are encoded each.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import let, own, quoted, stored, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNIT = re.compile("▁*[^▁\n]+|▁+|\n")
HOT_UNITS, LONG_UNIT, CACHED_UNITS, COUNTED_UNITS = 1 << 18, 48, 1 << 19, 1 << 19
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


class Model:
    """Pieces of a SentencePiece model with an identity normalizer and byte fallback."""

    def __init__(self, pieces: list[tuple[str, float, int]], kind: int, dummy_prefix: bool = True) -> None:
        self.kind, self.dummy_prefix = kind, dummy_prefix
        self.normal = {p: (i, s) for i, (p, s, t) in enumerate(pieces) if t == NORMAL}
        self.scores, self.no_merge = {p: s for p, (_, s) in self.normal.items()}, float("-inf")
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        self.longest = max((len(p) for p in self.normal), default=1)
        self.raw = [bytes([int(p[3:5], 16)]) if t == BYTE else p.encode() if t == NORMAL else b"" for p, _, t in pieces]
        self.worst = min((s for _, s in self.normal.values()), default=0.0) - 10.0
        crossing = [p for p in self.normal if re.search("[^▁]▁", p) or "\n" in p and len(p) > 1]
        if crossing:
            raise ValueError(f"pieces reach over the units of a text: {crossing[:3]}")

    @classmethod
    def load(cls, data: bytes) -> "Model":
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(data)
        spec = m.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models with an identity normalizer are known")
        return cls([(p.piece, p.score, p.type) for p in m.pieces], m.trainer_spec.model_type, spec.add_dummy_prefix)

    def units(self, text: str) -> list[str]:
        if not text:
            return []
        return UNIT.findall(((SPACE if self.dummy_prefix else "") + text).replace(" ", SPACE))

    def lines(self, text: str) -> list[list[str]] | None:
        """The words of each line between single spaces, a quicker way to the same units: all words but a later line's first carry
        a space in front. None where spaces stand together or the text starts with one, so that units differ from words."""
        if "  " in text or text[0] == " " or SPACE in text or not self.dummy_prefix:
            return None
        return [line.split(" ") for line in text.split("\n")]

    def fallback(self, symbol: str) -> list[int]:
        if symbol in self.normal:
            return [self.normal[symbol][0]]
        found = [self.bytes.get(b) for b in symbol.encode("utf-8", "surrogatepass")]
        return found if None not in found else [self.unknown]

    def encode_unit(self, unit: str) -> list[int]:
        """The lattice's fold on one unit, without Spark: edges by substring, then merges (BPE) or Viterbi (unigram)."""
        return self._viterbi(unit) if self.kind == UNIGRAM else self._merge(unit)

    def _viterbi(self, unit: str) -> list[int]:
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(unit) + 1):
            choice = None
            for start in range(max(0, end - self.longest), end):
                piece = self.normal.get(unit[start:end])
                score = piece[1] if piece else self.worst if end - start == 1 else None
                if score is not None and (choice is None or best[start][0] + score > choice[0]):
                    choice = (best[start][0] + score, start)
            best.append(choice)
        cuts, at = [], len(unit)
        while at:
            cuts.append((best[at][1], at))
            at = best[at][1]
        return [i for a, b in reversed(cuts) for i in self.fallback(unit[a:b])]

    def _merge(self, unit: str) -> list[int]:
        normal = self.normal
        if len(unit) <= LONG_UNIT:
            # scores of adjacent pairs are kept, so that a merge looks up its two neighbours only
            parts, none, score = list(unit), self.no_merge, self.scores.get
            scores = [score(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
            while scores:
                best = max(scores)
                if best == none:
                    break
                i = scores.index(best)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del scores[i]
                if i < len(scores):
                    scores[i] = score(parts[i] + parts[i + 1], none)
                if i:
                    scores[i - 1] = score(parts[i - 1] + parts[i], none)
        else:
            text, after, before = list(unit), list(range(1, len(unit) + 1)), list(range(-1, len(unit) - 1))
            heap: list[tuple[float, int, str]] = []

            def offer(i: int) -> None:
                if i >= 0 and after[i] < len(text):
                    both = text[i] + text[after[i]]
                    if both in normal:
                        heapq.heappush(heap, (-normal[both][1], i, both))

            for i in range(len(text) - 1):
                offer(i)
            while heap:
                _, i, both = heapq.heappop(heap)
                j = after[i]
                if text[i] is None or j >= len(text) or text[i] + text[j] != both:
                    continue
                text[i], text[j], after[i] = both, None, after[j]
                if after[i] < len(text):
                    before[after[i]] = i
                offer(before[i])
                offer(i)
            parts = [p for p in text if p is not None]
        return [i for p in parts for i in self.fallback(p)]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


class Ids(dict):
    """Ids of units as bytes of int32: the frequent ones are given, rarer ones are encoded when they come. Of those as many are
    kept as memory allows; a worker's tasks share them. Keys are units without ``front``."""

    def __init__(self, model: Model, frequent: dict[str, bytes], front: str = "") -> None:
        super().__init__(frequent)
        self.model, self.front, self.rare = model, front, {}

    def __reduce__(self):
        return Ids, (self.model, dict(self), self.front)

    def __missing__(self, key: str) -> bytes:
        found = self.rare.get(key)
        if found is None:
            if len(self.rare) >= CACHED_UNITS:
                self.rare.clear()
            found = self.rare[key] = array("i", self.model.encode_unit(self.front + key)).tobytes()
        return found


class Encoder:
    """Texts to ids (as bytes of int32), by what is known of units: those with one space in front are kept without it."""

    def __init__(self, model: Model, known: dict[str, bytes]) -> None:
        spaced = {u[1:]: ids for u, ids in known.items() if u[:1] == SPACE and u[1:2] != SPACE}
        self.model, self.spaced = model, Ids(model, spaced, SPACE)
        self.plain = Ids(model, {u: ids for u, ids in known.items() if u[:1] != SPACE or u[1:2] == SPACE})

    def encode(self, text: str) -> bytes:
        spaced, plain = self.spaced.__getitem__, self.plain.__getitem__
        lines = self.model.lines(text) if text else []
        if lines is None:
            return b"".join([spaced(u[1:]) if u[0] == SPACE and u[1:2] != SPACE else plain(u) for u in self.model.units(text)])
        out: list[bytes] = []
        for i, words in enumerate(lines):
            if i:
                out.append(plain("\n"))
                if words[0]:
                    out.append(plain(words[0]))
                del words[0]
            out.extend(map(spaced, words))
        return b"".join(out)


@lru_cache(2)
def model_of(path: str) -> Model:
    with open(path, "rb") as f:
        return Model.load(f.read())


def unit_counts(docs: DataFrame, text: str, model: Model) -> DataFrame:
    """(unit, n) over all texts; tasks count in maps that are emptied when they grow."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the tokenizer's file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, seen, spaced = shared.value, Counter(), Counter()

        def out() -> pa.RecordBatch:
            units, n = [*seen.keys(), *[SPACE + w for w in spaced.keys()]], [*seen.values(), *spaced.values()]
            seen.clear()
            spaced.clear()
            return pa.RecordBatch.from_arrays([pa.array(units, pa.string()), pa.array(n, pa.int64())], names=["unit", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                lines = m.lines(t) if t else []
                if lines is None:
                    seen.update(m.units(t))
                else:
                    for i, words in enumerate(lines):
                        if i:
                            seen["\n"] += 1
                            if words[0]:
                                seen[words[0]] += 1
                            del words[0]
                        spaced.update(words)
                if len(seen) + len(spaced) > COUNTED_UNITS:
                    yield out()
        yield out()

    return docs.select(quoted(text).alias("text")).mapInArrow(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The units that occur at least as often as the smallest threshold that lets at most ``most`` through."""
    steps = counts.groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.count(F.lit(1)).alias("units")).orderBy(F.desc("step")).collect()
    total, last = 0, None
    for r in steps:
        total += r["units"]
        if total > most:
            break
        last = r["step"]
    return counts.where(F.lit(False) if last is None else F.floor(F.log2("n") * 8) >= last)


def edges(units: DataFrame, model: Model) -> DataFrame:
    """(unit, edges) with edges an array of struct(start, end, id, score) of all pieces in the unit."""
    spark = units.sparkSession
    pieces = spark.createDataFrame([(p, i, float(s)) for p, (i, s) in model.normal.items()], "piece string, id int, score double")
    starts = F.explode(F.sequence(F.lit(0), F.length("unit") - 1)).alias("start")
    cut = units.select("unit", starts)
    ends = F.explode(F.sequence(F.col("start") + 1, F.least(F.length("unit"), F.col("start") + model.longest))).alias("end")
    cut = cut.select("unit", "start", ends).withColumn("piece", F.substring(F.col("unit"), F.col("start") + 1, F.col("end") - F.col("start")))
    # the table of pieces is bounded by the tokenizer
    found = cut.join(F.broadcast(pieces), "piece", "left").where("id is not null or end = start + 1")
    edge = F.struct("start", "end", "id", "score", "piece")
    return found.groupBy("unit").agg(F.collect_list(edge).alias("edges"))


def folded(unit: Column, lattice: Column, model: Model) -> Column:
    """Array of (start, end) of the pieces that the fold chooses."""
    n = F.length(unit)
    if model.kind == UNIGRAM:
        by_end = lambda e: F.filter(lattice, lambda x: x["end"] == e)
        first = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("start")))

        def step(best: Column, end: Column) -> Column:
            options = F.transform(
                by_end(end),
                # of equal scores the smaller start wins
                lambda x: F.struct((F.get(best, x["start"])["score"] + F.coalesce(x["score"], F.lit(model.worst))).alias("score"), (-x["start"]).alias("start")),
            )
            return let(F.array_max(options), lambda c: F.array_append(best, F.struct(c["score"].alias("score"), (-c["start"]).alias("start"))))

        best = F.aggregate(F.sequence(F.lit(1), n), first, step)
        empty = F.expr("cast(array() as array<int>)")

        def back(b: Column) -> Column:
            cuts = F.aggregate(
                F.sequence(F.lit(1), n),
                F.struct(n.alias("at"), F.array(n).alias("cuts")),
                lambda a, _: F.when(
                    a["at"] > 0, F.struct(F.get(b, a["at"])["start"].alias("at"), F.array_prepend(a["cuts"], F.get(b, a["at"])["start"]).alias("cuts"))
                ).otherwise(a),
                lambda a: a["cuts"],
            )
            return F.coalesce(cuts, empty)

        return let(best, back)
    # BPE: cuts between symbols start at every character; the best edge over two symbols removes the cut inside it
    scores = F.map_from_entries(F.transform(F.filter(lattice, lambda x: x["id"].isNotNull()), lambda x: F.struct(x["start"] * 1024 + x["end"], x["score"])))

    def merging(known: Column) -> Column:
        def step(cuts: Column, _: Column) -> Column:
            options = F.transform(
                F.sequence(F.lit(0), F.greatest(F.size(cuts) - 3, F.lit(0))),
                lambda i: F.struct(F.try_element_at(known, F.get(cuts, i) * 1024 + F.get(cuts, i + 2)).alias("score"), (-i).alias("i")),
            )
            # structs compare by score, then by the leftmost place; a missing score is lower than any
            return let(F.array_max(options), lambda o: F.when(o["score"].isNull(), cuts).otherwise(F.filter(cuts, lambda x, j: j != 1 - o["i"])))

        return F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), F.sequence(F.lit(0), n), step)

    return let(scores, merging)


def encoded_units(units: DataFrame, model: Model) -> DataFrame:
    """(unit, pieces) with pieces an array of struct(id, piece), id null where no piece is known."""
    lattice = edges(units, model)
    at = lambda lattice, a, b: F.filter(lattice, lambda x: (x["start"] == a) & (x["end"] == b))[0]

    def named(cuts: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(cuts) - 2), lambda i: let(at(F.col("edges"), F.get(cuts, i), F.get(cuts, i + 1)), lambda e: F.struct(e["id"].alias("id"), e["piece"].alias("piece"))))

    return lattice.select("unit", let(folded(F.col("unit"), F.col("edges"), model), named).alias("pieces"))


def dictionary(docs: DataFrame, text: str, model: Model, hot_units: int = HOT_UNITS) -> dict[str, bytes]:
    """Ids (as bytes of int32) of the frequent units, at most ``hot_units``."""
    counts = stored(unit_counts(docs, text, model), "units")
    hot = frequent(counts, hot_units).where(F.length("unit") <= LONG_UNIT).select("unit")
    made = stored(encoded_units(hot.repartition(F.col("unit")), model), "pieces")
    out = {}
    for r in made.select("unit", F.transform("pieces", lambda p: p["id"]), F.transform("pieces", lambda p: F.when(p["id"].isNull(), p["piece"]))).toLocalIterator():
        ids = [i for known, piece in zip(r[1], r[2], strict=True) for i in ([known] if known is not None else model.fallback(piece))]
        out[r[0]] = np.array(ids, np.int32).tobytes()
    return out


ADDED = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType()), T.StructField("round_trip", T.BooleanType())])


def widened(rows: DataFrame, text: str, added: T.StructType) -> tuple[DataFrame, int, T.StructType]:
    """(columns of ``rows`` but those that ``added`` replaces, place of the column ``text`` among them, schema with the added ones)."""
    kept = rows.select(*own(rows, *added.names))
    places = [i for i, c in enumerate(kept.columns) if c.lower() == text.lower()]
    if not places:
        raise ValueError(f"{text} is not a column, or the name of one that is added: {rows.columns}")
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in kept.schema.fields], *added.fields])
    # names by place on the way to Python, since Arrow functions look columns up by names without quoting them
    return kept.toDF(*[f"c{i}" for i in range(len(kept.columns))]), places[0], schema


def encode(docs: DataFrame, text: str = "text", model_path: str = MODEL, hot_units: int = HOT_UNITS, verify: bool = True) -> DataFrame:
    """Adds ``ids`` (array of int), ``n_pieces`` and ``round_trip`` (decoding gives the text again; U+2581 counts as a space). These
    take the place of columns of the same name, all others are kept."""
    spark, model = docs.sparkSession, model_of(model_path)
    shared = spark.sparkContext.broadcast(Encoder(model, dictionary(docs, text, model, hot_units)))
    rows, at, schema = widened(docs, text, ADDED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value
        m = encoder.model
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                parts, ends, good, nulls = [], [0], [], []
                for t in batch.column(at).to_pylist():
                    data = encoder.encode(t or "")
                    parts.append(data)
                    ends.append(ends[-1] + len(data) // 4)
                    nulls.append(t is None)
                    good.append(None if t is None else not verify or m.decode(np.frombuffer(data, np.int32).tolist()) == t.replace(SPACE, " "))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), np.int32)), mask=pa.array(nulls))
                n = pa.array([None if x else b - a for x, a, b in zip(nulls, ends, ends[1:], strict=False)], pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.columns, ids, n, pa.array(good, pa.bool_())], names=schema.names)

    return rows.mapInArrow(run, schema)


def decode(rows: DataFrame, ids: str = "ids", model_path: str = MODEL) -> DataFrame:
    """Adds ``decoded``, the text of an array of ids, in place of a column of that name; null stays null."""
    shared = rows.sparkSession.sparkContext.broadcast(model_of(model_path))
    rows, at, schema = widened(rows, ids, T.StructType([T.StructField("decoded", T.StringType())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if x is None else shared.value.decode(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_pieces", "ids", "round_trip")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: every row of its input with its ids instead of its text; ``ids``, ``n_pieces`` and ``round_trip`` take the
    place of columns of the same name."""
    return encode(docs).drop("text")
