"""Passages against all equal runs of all pairs of texts, and against edited copies, by a quadratic comparison."""

import random

import numpy as np

from tessera.llm import passages
from tests.llm.test_ops import DOCS
from tests.llm.test_passages_licenses import prose

LONG = 50


def equal_runs(a, b):
    """All maximal equal runs (start, stop in a) of LONG words or more."""
    out, before = set(), np.zeros(len(b) + 1, np.int64)
    for i, w in enumerate(a):
        now = np.zeros(len(b) + 1, np.int64)
        now[1:] = np.where(b == w, before[:-1] + 1, 0)
        ended = before[:-1][(before[:-1] >= LONG) & (now[1:] == 0)]
        out |= {(i - int(n), i) for n in ended}
        if before[-1] >= LONG:
            out.add((i - int(before[-1]), i))
        before = now
    out |= {(len(a) - int(n), len(a)) for n in before[before >= LONG]}
    return out


def found_in(spark, texts):
    rows = passages.passages(spark.createDataFrame([(i, " ".join(t), None, None, None) for i, t in enumerate(texts)], DOCS)).collect()
    held = [np.zeros(len(t), bool) for t in texts]
    for r in rows:
        held[r["doc_id"]][r["start"] : r["stop"]] = True
        x, y = texts[r["doc_id"]][r["start"] : r["stop"]], texts[r["other_id"]][r["other_start"] : r["other_stop"]]
        assert passages._equal_words(np.array([hash(w) for w in x]), np.array([hash(w) for w in y])) >= r["n_equal"] >= passages.MIN_IDENTITY * r["n_words"]
    return held


def test_equal_runs_of_all_pairs_are_found(spark):
    """Texts of pieces from a pool, in any order and repeated inside a text, so that seeds have many leaders and offsets differ."""
    rng = random.Random(13)
    pool = [prose(rng, rng.choice([25, 30, 40, 60, 90])) for _ in range(14)]
    texts = []
    for _ in range(90):
        words = []
        for _ in range(rng.randint(1, 9)):
            words += rng.choice(pool) if rng.random() < 0.85 else prose(rng, rng.randint(1, 30))
        texts.append(words)
    held = found_in(spark, texts)
    numbers = {w: i for i, w in enumerate({w for t in texts for w in t})}
    coded = [np.array([numbers[w] for w in t], np.int64) for t in texts]
    runs = [(d, a, b) for d in range(len(texts)) for a, b in set().union(*[equal_runs(coded[d], coded[e]) for e in range(d)] or [set()])]
    covered = [held[d][a:b].mean() for d, a, b in runs]
    assert len(runs) > 100 and np.mean([c >= 0.95 for c in covered]) >= 0.98, (len(runs), np.mean(covered), np.mean([c >= 0.95 for c in covered]))


def edited(rng, words, share):
    out = []
    for w in words:
        x = rng.random()
        if x < share / 3:
            continue
        out += prose(rng, 1) if x < 2 * share / 3 else [w, *prose(rng, 1)] if x < share else [w]
    return out


def test_recall_of_edited_passages(spark):
    """Passages of 100 words with edits at random places: almost all are found from 93 percent equal on."""
    rng = random.Random(17)
    share = {0.02: 0.97, 0.05: 0.97, 0.08: 0.9}
    for edits, least in share.items():
        first = [prose(rng, 100) for _ in range(60)]
        second = [prose(rng, 30) + edited(rng, p, edits) + prose(rng, 30) for p in first]
        held = found_in(spark, [*first, *second])
        assert np.mean([h[30:-30].mean() > 0.5 for h in held[60:]]) >= least, edits
        assert np.mean([h[:20].mean() + h[-20:].mean() for h in held[60:]]) < 0.02
