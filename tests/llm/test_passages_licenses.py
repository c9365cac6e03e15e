"""Passages against planted ones and a quadratic chaining; license blocks against planted notices."""

import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import licenses, passages
from tests.llm.test_ops import DOCS, clashing


def prose(rng, n):
    return ["".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(3, 8))) for _ in range(n)]


def test_passages(spark):
    rng = random.Random(1)
    shared, short = prose(rng, 70), prose(rng, 30)
    rows, places = [(i, prose(rng, 150)) for i in range(12)], {}
    for i in (2, 5, 7, 9):
        at = rng.randrange(100)
        p = list(shared)
        if i >= 7:
            for k in (18, 40, 41):  # replaced, dropped and added words
                p[k] = prose(rng, 1)[0]
            p.insert(55, "added")
            del p[60]
        rows[i][1][at:at] = [w.upper() if i == 5 else w for w in p]
        places[i] = (at, at + len(p))
    for i in (3, 4):
        rows[i][1][20:20] = short
    rows += [(20, rows[0][1]), (21, [])]
    data = [(i, " ".join(w), None, None, None) for i, w in rows] + [(22, None, None, None, None), (0, " ".join(rows[0][1]), None, None, None)]
    got = {(r["doc_id"], r["other_id"]): r for r in passages.passages(clashing(spark.createDataFrame(data, DOCS))).collect()}
    # copies with the same edits may also be found against each other
    assert {(5, 2), (7, 2), (9, 2), (20, 0)} <= set(got) <= {(i, j) for i in places for j in places if i > j} | {(20, 0)}
    for i in (5, 7, 9):
        r = got[i, 2]
        assert abs(r["start"] - places[i][0]) <= 1 and abs(r["stop"] - places[i][1]) <= 1 and abs(r["other_start"] - places[2][0]) <= 1
        assert r["n_equal"] >= (70 if i == 5 else 65)
    assert (got[20, 0]["start"], got[20, 0]["stop"], got[20, 0]["n_equal"]) == (0, 150, 150)
    assert passages.passages(spark.createDataFrame([], DOCS)).count() == 0


def test_common_passage_stays_linear(spark):
    rng = random.Random(2)
    p = prose(rng, 60)
    data = [(i, " ".join(prose(rng, 20) + p + prose(rng, 20)), None, None, None) for i in range(80)]
    got = passages.passages(spark.createDataFrame(data, DOCS)).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(1, 80)) and {r["other_id"] for r in got} == {0}


def test_seeds_meet_in_equal_runs():
    rng = np.random.default_rng(3)
    for _ in range(200):
        run = rng.integers(0, 2**63, passages.K + passages.WINDOW - 1).astype(np.uint64)
        a, b = (np.concatenate([rng.integers(0, 2**63, 30).astype(np.uint64), run, rng.integers(0, 2**63, 30).astype(np.uint64)]) for _ in range(2))
        assert set(passages.seeds(a)[0].tolist()) & set(passages.seeds(b)[0].tolist())
    assert len(passages.seeds(np.arange(5, dtype=np.uint64))[0]) == 0


@pytest.mark.parametrize("seed", range(30))
def test_chaining_finds_the_best_score(seed):
    rng = random.Random(seed)
    pts = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(12)})
    x, y = (np.array(c, np.int64) for c in zip(*pts, strict=True))
    segs = passages.segments(x, y)
    over = passages.K - 1  # seeds may overlap by less than their length
    best = []
    for i, (a, b, n) in enumerate(segs):
        value = float(n)
        for j in range(i):
            p, q, m = segs[j]
            if p + m <= a + over and q + m <= b + over and q < b and a - p - m <= passages.MAX_GAP and b - q - m <= passages.MAX_GAP:
                value = max(value, n + best[j] - passages.GAP_COST * (a - p - m + b - q - m))
        best.append(value)

    def score(chain):
        total = float(chain[0][2])
        for (p, q, m), (a, b, n) in zip(chain, chain[1:], strict=False):
            total += n - passages.GAP_COST * (a - p - m + b - q - m)
        return total

    found = passages.chains(x, y)
    assert sorted(s for c in found for s in c) == segs
    assert abs(score(found[0]) - max(best)) < 1e-9 or max(map(score, found)) >= 0.9 * max(best)


def exact_alike(rng, parts, gap):
    """Two texts that share runs of the given lengths, ``gap`` words of their own apart."""
    new = lambda n: rng.integers(0, 2**63, n).astype(np.uint64)
    a, b = [new(30)], [new(25)]
    for n in parts:
        run = new(n)
        a += [run, new(gap)]
        b += [run, new(gap)]
    return np.concatenate(a), np.concatenate(b)


def chained(a, b):
    (g, p), (h, q) = passages.seeds(a), passages.seeds(b)
    at = dict(zip(h.tolist(), q.tolist(), strict=True))
    both = [(x, at[s]) for s, x in zip(g.tolist(), p.tolist(), strict=True) if s in at]
    return passages.chains(*(np.array(c, np.int64) for c in zip(*both, strict=True)))


@pytest.mark.parametrize("parts,gap", [((50, 19), 18), ((50, 19), 20), ((50, 24), 25), ((50, 50), 26), ((50, 50), 38), ((19, 50, 19), 22)])
def test_chains_are_cut_at_gaps(parts, gap):
    rng = np.random.default_rng(5)
    for _ in range(20):
        a, b = exact_alike(rng, parts, gap)
        found = [r for c in chained(a, b) for r in passages.alike(a, b, c, passages.MIN_WORDS, passages.MIN_IDENTITY)]
        x = 30
        for n in parts:
            if n == 50:
                assert any(r[0] <= x and r[1] >= x + n for r in found), (parts, gap, found)
            x += n + gap
        for x, x2, y, y2, equal in found:
            assert min(x2 - x, y2 - y) >= passages.MIN_WORDS and passages.MIN_IDENTITY * max(x2 - x, y2 - y) <= equal <= min(x2 - x, y2 - y)


def test_exact_passages_beside_other_matches(spark):
    rng = random.Random(6)
    data, places = [], {}
    for k, (parts, gap) in enumerate([((50, 19), 20), ((50, 50), 30), ((50, 24), 25)] * 3):
        a, b = prose(rng, 30), prose(rng, 25)
        for n in parts:
            run = prose(rng, n)
            if n == 50:
                places.setdefault(2 * k + 1, []).append(len(b))
            a, b = a + run + prose(rng, gap), b + run + prose(rng, gap)
        data += [(2 * k, " ".join(a), None, None, None), (2 * k + 1, " ".join(b), None, None, None)]
    got = passages.passages(spark.createDataFrame(data, DOCS)).collect()
    for i, starts in places.items():
        for at in starts:
            assert any(r["doc_id"] == i and r["other_id"] == i - 1 and r["start"] <= at and r["stop"] >= at + 50 for r in got), (i, at)


def test_every_copy_in_a_document_is_found(spark):
    rng = random.Random(7)
    p, q = prose(rng, 60), prose(rng, 60)
    own = lambda: prose(rng, 50)
    rows = [own() + p + own(), own() + p + own() + p + own() + p, own() + q + own() + q, own() + q + own() + q + own() + q]
    got = passages.passages(spark.createDataFrame([(i, " ".join(w), None, None, None) for i, w in enumerate(rows)], DOCS)).collect()
    for i, other, starts in ((1, 0, (50, 160, 270)), (3, 2, (50, 160, 270))):
        for at in starts:
            assert any(r["doc_id"] == i and r["other_id"] == other and r["start"] <= at and r["stop"] >= at + 60 for r in got), (i, at)


def test_passages_of_pieces_with_other_leaders(spark):
    rng = random.Random(8)
    data, own = [], lambda: prose(rng, 40)
    for k in range(0, 80, 4):
        p, q = prose(rng, 30), prose(rng, 30)
        for i, middle in enumerate((p, q, p + q, p + q)):
            data.append((k + i, " ".join(own() + middle + own()), None, None, None))
    # one earlier document holds both pieces, the other way round
    p, q = prose(rng, 30), prose(rng, 30)
    for i, middle in enumerate((q + own() + own() + p, p + q, p + q)):
        data.append((100 + i, " ".join(own() + middle + own()), None, None, None))
    got = {(r["doc_id"], r["other_id"]): r for r in passages.passages(spark.createDataFrame(data, DOCS)).collect()}
    for i in [*range(3, 80, 4), 102]:
        assert got[i, i - 1]["start"] <= 40 and got[i, i - 1]["stop"] >= 100
    assert all(i % 4 == 3 or i == 102 for i, _ in got)


MIT = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 200)


def test_licenses(spark):
    rng = random.Random(4)
    filler = " ".join(prose(rng, 60)) + "."
    wrapped = MIT[:200].rsplit(" ", 1)[0] + "\n" + MIT[len(MIT[:200].rsplit(" ", 1)[0]) + 1 :]
    cases = {
        1: ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0", 0), 2: ("licensed under CC BY-ND 4.0", "CC-BY-ND-4.0", 0), 3: ("Copyright (c) 2021. All rights reserved.", "proprietary", 0),
        4: ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0", 0), 5: ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0", 0),
        6: (wrapped, "MIT", 0), 7: (MIT.replace("merge", "melt"), "MIT", 2),
    }
    rows = [(i, f"{filler}\n{t}\n{filler}", None, None, None) for i, (t, _, _) in cases.items()]
    rows += [(20, filler, None, None, None), (21, None, None, None, None), (22, "", None, None, None), (23, "we talked about the permission to enter\n" + filler, None, None, None)]
    rows += [(24, ("word " * 30000) + ". Released under the MIT License. " + ("more " * 30000), None, None, None), rows[0]]
    out = licenses.license_scan(clashing(spark.createDataFrame(rows, DOCS))).collect()
    good = [r for r in out if r["confirmed"]]
    assert sorted(r["doc_id"] for r in good) == sorted([*cases, 1, 24])
    for r in good:
        if r["doc_id"] in cases:
            text, name, n = cases[r["doc_id"]]
            assert r["license"] == name and r["n_differences"] == n and r["start"] == len(filler) + 1 and r["stop"] == len(filler) + 1 + len(text)
    assert next(r for r in good if r["doc_id"] == 7)["differences"] == "-merge +melt"
    assert licenses.license_scan(spark.createDataFrame([], DOCS)).count() == 0 and F is not None


def test_licenses_in_prose_and_wrapped(spark):
    rng = random.Random(9)
    before, after = " ".join(prose(rng, 20)), " ".join(prose(rng, 30))
    short = {"MIT": "Released under the MIT License.", "CC-BY-4.0": "Licensed under CC BY 4.0.", "proprietary": "All rights reserved.", "Apache-2.0": "Licensed under the Apache License, Version 2.0."}
    short["GPL-3.0"] = "This work is licensed under the GNU General Public License, version 3."
    cases = [(name, f"{before}. {t} {after}", t) for name, t in short.items()] + [(name, f"{before}. {t} {after * 4}", t) for name, t in short.items()]
    notice = next(t for n, t in licenses.TEMPLATES if n == "Apache-2.0" and len(t) > 100)
    wrapped = notice.replace("; you", ";\nyou").replace(". You", ".\nYou").replace(" at http", " at\nhttp")
    cases.append(("Apache-2.0", f"{before}\n{wrapped}\n{after}", wrapped))
    rows = [(i, t, None, None, None) for i, (_, t, _) in enumerate(cases)]
    good = {r["doc_id"]: r for r in licenses.license_scan(spark.createDataFrame(rows, DOCS)).collect() if r["confirmed"]}
    for i, (name, text, want) in enumerate(cases):
        assert good[i]["license"] == name and text[good[i]["start"] : good[i]["stop"]].rstrip(".") == want.rstrip("."), (name, text, good.get(i))
