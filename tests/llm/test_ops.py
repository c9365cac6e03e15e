"""Operators on small tables with nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import base64
import collections
import hashlib
import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing, neardup, pieces, pii, quality, urls, vectors, warc
from tessera.llm.common import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: names that operators use inside, as columns of the input
CLASH = {"size": 1, "h": 2, "key": "k", "n": 3, "host": "x", "bucket": 4, "label2": 5, "_q": 6, "rep": 7, "component": 8, "ids2": 9}


def words(rng, n):
    return " ".join("".join(rng.choice(string.ascii_lowercase[:9]) for _ in range(rng.randint(1, 5))) for _ in range(n))


def corpus(seed=0):
    rng = random.Random(seed)
    base = [words(rng, n) for n in (60, 80, 120, 200, 3, 2, 1)]
    texts = [None, "", " \t\n ", "a", "A", "a b", *base, *base[:3], "long " * 30000, "x" * 60000]
    for b in base[:4]:  # near copies of several degrees
        ws = b.split(" ")
        for k in (1, 2, 4, 8):
            c = list(ws)
            for _ in range(k):
                c[rng.randrange(len(c))] = words(rng, 1)
            texts.append(" ".join(c))
    texts += ["line one is here\n" * 40, "\n\nsame\nsame\n" + base[2], "é ü 日本 😀 " * 30, "a\x0bb\x0cc d\x1ee"]
    rows = [(i, t, "en", [None, "s1", "s2", "S3", "é"][i % 5], len(t or "")) for i, t in enumerate(texts)]
    return rows + rows[8:11]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df):
    return df.withColumns({k: F.lit(v) for k, v in CLASH.items()})


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7), (60, 60)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# 7


def brute_quality(text):
    t = text or ""
    w = split(t)
    windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in t.split("\n") if split(x)]
    base = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), base)


def test_quality(docs, empty):
    rows = quality.quality(clashing(docs)).collect()
    got = collections.Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows)
    assert got == collections.Counter((d[0], *brute_quality(d[1])) for d in corpus())
    assert all(not r["kept"] for r in rows if r["base_failed"])
    assert quality.quality(empty).count() == 0
    kept = quality.stage(None, clashing(docs), "")
    assert kept.columns == clashing(docs).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in rows if r["kept"])
    assert quality.stage(None, empty, "").count() == 0


def test_bad_host_goes_good_host_stays(spark):
    rng = random.Random(3)
    good = [(i, words(rng, 80), "en", "good", 0) for i in range(40)]
    bad = [(100 + i, words(rng, 80) if i % 10 == 0 else "spam # " * 60, "en", "bad", 0) for i in range(40)]
    kept = quality.quality(spark.createDataFrame(good + bad, DOCS)).where("kept").groupBy("host").count().collect()
    assert [tuple(r) for r in kept] == [("good", 40)]


# 9


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute_pii(text):
    t, out = text or "", []
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(re.sub("[ -]", "", s)) <= 19 and luhn(re.sub("[ -]", "", s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= sum(c.isdigit() for c in s) <= 15),
    ]
    for kind, pattern, ok in kinds:
        out += [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, t) if ok(m[0])]
    return ",".join(out)


def brute_added(text):
    """Spans of the added kinds, by a plain reading of their definitions."""
    t, out = text or "", []

    def nir(h):
        return bool(re.fullmatch(pii.FORMS["nir"], h)) and 97 - int(h[:13]) % 97 == int(h[13:])

    def iban(h):
        c = h.replace(" ", "")
        return 15 <= len(c) <= 34 and int("".join(str(int(x, 36)) for x in c[4:] + c[:4])) % 97 == 1

    runs = {
        "iban": (pii.PATTERNS["iban"], iban),
        "nir": ("[0-9A-Za-z]+", nir),
        "dni": ("[0-9A-Za-z]+", lambda h: bool(re.fullmatch("[0-9]{8}[A-Z]", h)) and pii.DNI_LETTERS[int(h[:8]) % 23] == h[8]),
        "ssn": ("[0-9-]+", lambda h: bool(re.fullmatch("[0-9]{3}-[0-9]{2}-[0-9]{4}", h)) and h[:3] not in ("000", "666") and h[0] != "9" and h[4:6] != "00" and h[7:] != "0000"),
        "secret": ("[0-9A-Za-z]+", lambda h: bool(re.fullmatch("[0-9a-f]{32,64}", h)) and bool(re.search("[0-9]", h)) and bool(re.search("[a-f]", h))),
    }
    for kind, (pattern, ok) in runs.items():
        for m in re.finditer(pattern, t):
            beside = t[max(0, m.start() - 1) : m.start()] + t[m.end() : m.end() + 1]
            before = t[max(0, m.start() - pii.CONTEXT) : m.start()].translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
            score = pii.SCORES[kind] + pii.RAISED_BY * any(w in before for w in pii.CONTEXT_WORDS[kind]) - pii.LOWERED_BY * any(w in before for w in pii.AGAINST_WORDS[kind])
            if ok(m[0]) and (kind != "iban" or not re.search("[0-9A-Za-z]", beside)) and score >= pii.ACCEPTED - 1e-12:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


HEX = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
PII = [
    None, "", "mail a.b@c.de or x@y, z_@q.r.s_t@u.vw 😀 e@f.gh", "1.2.3.4.5 256.1.1.1 0001.2.3.255 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112, 79927398713 378282246310005",
    "+49 (0)30 1234567. +1 23 +123456789012345678", "a@" * 50, "a" * 40000 + "@b.c", "1" * 30000, "+1" + " " * 30000, ("p@q.rs " * 700), "5 5 5 5", "x@y.z@w.v", "+12345678901@a.bc 1.1.1.1@d.ef",
    "IBAN DE89370400440532013000 or DE89370400440532013001, ssn 123-45-6789 but 123-45-6780 too", "é" * 50 + " ä@b.co ü", "1-" * 9000,
    f'token = "{HEX}"', f"commit {HEX} of the api key", f"x{HEX} key {HEX}z token {HEX[:31]} {'key ' + 'a' * 40} auth {HEX[:32]}", "é DE89 3704 0440 0532 0130 00. sample iban GB82 WEST 1234 5698 7654 32 GB82WEST12345698765432",
    "nir 255081416802538 or 255081416802539, 255081416802538x", "DNI 12345678Z, 12345678A. " + "x" * 50 + " 12345678Z", "SSN 000-12-3456 666-12-3456 912-12-3456 123-00-4567 123-45-0000 123-45-6789 1123-45-6789 123-45-67890", "tax id " + "9" * 50 + " 123-45-6789",
]


def test_pii(spark):
    rows = [(i, t, None, None, None) for i, t in enumerate(PII)] + [(2, PII[2], None, None, None)]
    df = clashing(spark.createDataFrame(rows, DOCS))
    got = pii.personal_data(df).select("doc_id", pii.joined(pii.BASE_KINDS).alias("base"), pii.joined(pii.KINDS).alias("all"), pii.redacted(F.col("text")).alias("red")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["base"] == brute_pii(PII[r["doc_id"]]), r["doc_id"]
        assert r["all"] == ",".join(x for x in [r["base"], *brute_added(PII[r["doc_id"]])] if x), r["doc_id"]
    by = {r["doc_id"]: r for r in got}
    iban = PII[14].index("DE89")
    assert f"iban:{iban}:{iban + 22}" in by[14]["all"] and by[14]["all"].count("iban") == 1 and by[14]["all"].count("ssn") >= 1
    assert by[3]["red"] == "<IP>.5 256.1.1.1 <IP> 1.2.3" and by[0]["red"] is None and by[1]["red"] == ""
    assert sum("secret" in r["all"] for r in got) == 2 and "nir" in by[21]["all"] and by[22]["all"].count("dni") == 1 and by[23]["all"].count("ssn") == 0 and by[14]["all"].count("ssn") == 2
    df = df.withColumns({"pii_email": F.lit("kept"), "PII__ip": F.lit(3)})
    out = pii.stage(spark, df, "")
    assert {r["pii_email"] for r in out.collect()} == {"kept"}
    low = pii.personal_data(spark.createDataFrame([("version 1.2.3.4, host 1.2.3.4",)], "text string")).select(pii.redacted(F.col("text"), least=0.5).alias("t")).first()
    assert low["t"] == "version 1.2.3.4, host <IP>"
    assert out.columns == df.columns and out.where("doc_id = 3").first()["n_chars"] == len(by[3]["red"])
    assert pii.stage(spark, spark.createDataFrame([], DOCS), "").count() == 0


def test_mod97_and_luhn(spark):
    cases = [("GB82WEST12345698765432", True), ("GB82WEST12345698765431", False), ("FR1420041010050500013M02606", True)]
    assert [r[0] for r in spark.createDataFrame([(c,) for c, _ in cases], "s string").select(pii.mod97(F.col("s"))).collect()] == [x for _, x in cases]


# 10


def test_urls(spark):
    cases = [
        (1, "http://A.Example.NET/en/x?q", "a.example.net", "/en/x", "example.net/en/", "allow"),
        (2, "https://example.net/fr/x#t", "example.net", "/fr/x", "net/", "block"),
        (3, "http://www.example.com/de/1", "www.example.com", "/de/1", "example.com/de/", "block"),
        (4, "http://badexample.com/de/1", "badexample.com", "/de/1", None, "allow"),
        (5, "http://x.org/fr/", "x.org", "/fr/", "org/fr/", "allow"),
        (6, "http://example.net", "example.net", "", None, "allow"),
        (7, "no scheme", "", "", None, "allow"),
        (8, None, "", "", None, "allow"),
        (9, "a://b?c://d/e", "b", "", None, "allow"),
        (10, "http://É.net/En/", "É.net", "/En/", "net/", "block"),
    ]
    df = spark.createDataFrame([(c[0], c[1]) for c in cases] + [(1, cases[0][1])], "page_id long, url string").withColumns({"s1": F.lit(1), "host": F.lit("z"), "path": F.lit("p")})
    got = sorted(tuple(r)[:5] for r in urls.url_filter(df).select("page_id", "host", "path", F.coalesce("rule", F.lit("-")), "verdict").collect())
    assert got == sorted([(i, h, p, r or "-", v) for i, _, h, p, r, v in cases] + [(1, *[x or "-" for x in cases[0][2:]])])
    assert urls.url_filter(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_template_verdicts(spark):
    pages = [(i, f"http://h.xyz/ads/{i}") for i in range(20)] + [(100 + i, f"http://h.xyz/news/{i}") for i in range(20)]
    labels = spark.createDataFrame([(i, True) for i in range(10)] + [(100 + i, False) for i in range(10)], "page_id long, bad boolean")
    out = urls.url_filter(spark.createDataFrame(pages, "page_id long, url string"), labels=labels)
    assert {(r["path"].split("/")[1], r["verdict"]) for r in out.collect()} == {("ads", "block"), ("news", "allow")}


# 4


def test_targets():
    sizes = [("a", 100), ("b", 1000), ("c", 10), (None, 500)]
    assert mixing.targets(sizes) == [200, 1195, 20, 1000]  # the excess of a and c goes to the rest, that of null to b
    assert mixing.targets([("a", 100), ("b", 100), ("c", 100)], (3, 1, 2)) == [200, 250 / 3, 500 / 3]
    assert mixing.targets([("a", 0)]) == [0.0] and mixing.targets([]) == []


def test_mixing(docs, empty):
    def run(df):
        rows, parts = mixing.mix(clashing(df), ["doc_id"])
        return sorted((r["keep"]["doc_id"], r["size"], r["source_size"], r["target"], r["taken"], r["src"]) for r in mixing.taken_words(rows, parts).collect())

    got = run(docs)
    assert got == run(docs.repartition(5).orderBy(F.rand()))
    want = collections.Counter((d[0], len(split(d[1]))) for d in corpus())
    assert collections.Counter((i, n) for i, n, *_ in got) == want
    by = collections.defaultdict(list)
    for i, n, s, target, taken, src in got:
        assert 0 <= taken <= 2 * n
        by[src].append((n, s, target, taken))
    for xs in by.values():
        assert sum(x[0] for x in xs) == xs[0][1] and abs(sum(x[3] for x in xs) - xs[0][2]) <= 1
    assert run(empty) == []
    out = mixing.stage(None, clashing(docs), "")
    assert out.columns == clashing(docs).columns and mixing.stage(None, empty, "").count() == 0


def test_schedule_is_even(spark):
    plan = [{"src": 0, "words": 3000}, {"src": 1, "words": 1000}, {"src": 2, "words": 55}]
    rows = mixing.schedule(spark, plan, 10).orderBy("slot").collect()
    for src, n in ((0, 300), (1, 100), (2, 6)):
        mine = [r for r in rows if r["src"] == src]
        assert sorted(r["block"] for r in mine) == list(range(n)) and sum(r["words"] for r in mine) == plan[src]["words"]
    half = [r["src"] for r in rows[:200]]
    assert abs(half.count(0) - 148) <= 4 and abs(half.count(1) - 49) <= 4


# 3


def brute_near(rows, width, percent):
    sets = {}
    for i, t, *_ in rows:
        w = [x.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)) for x in split(t)]
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, empty, width, percent):
    want = brute_near(corpus(), width, percent)
    rows = neardup.near_duplicates(clashing(docs), width, percent).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    assert neardup.near_duplicates(empty).count() == 0


def test_group_of_near_copies(spark):
    """A group in which many pairs lie about the threshold, so that blocks must finish what leaders leave."""
    rng = random.Random(7)
    base = words(rng, 90).split(" ")
    rows = []
    for i in range(150):
        c = list(base)
        for _ in range(rng.randrange(7)):
            c[rng.randrange(len(c))] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(c), None, None, None))
    want = brute_near(rows, 3, 85)
    got = neardup.near_duplicates(spark.createDataFrame(rows, DOCS), 3, 85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert 1 < len({c for _, c in want.values()}) < 150


def test_near_stage(docs):
    out = neardup.stage(None, clashing(docs), "")
    ids = [r["doc_id"] for r in out.collect()]
    assert len(ids) == len(set(ids)) and set(ids) == {i for i, (_, c) in brute_near(corpus(), 5, 80).items() if i == c} and set(out.columns) == set(clashing(docs).columns)


def test_sketches_merge_and_estimate():
    mul, add = neardup._multipliers()
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        both = rng.integers(0, 2**63, int(4000 * share), np.uint64)
        a, b = (np.concatenate([both, rng.integers(0, 2**63, 4000 - len(both), np.uint64)]) for _ in range(2))
        sa, sb = (neardup.registers(x, mul, add) for x in (a, b))
        assert (neardup.registers(np.concatenate([a, b]), mul, add) == np.maximum(sa, sb)).all()
        true = len(both) / (8000 - len(both))
        est = neardup.likely_similarity(sa[None], sb[None], np.array([4000.0]), np.array([4000.0]))[0]
        assert abs(est - true) < 0.13


# 6


def test_vectors(spark):
    rng = np.random.default_rng(5)
    rows, n = [], 0
    for label in (1, 2, None):
        for _ in range(25):
            c = rng.standard_normal(8)
            for _ in range(rng.integers(1, 5)):
                rows.append((n, [float(np.float32(x)) for x in c + rng.standard_normal(8) * 0.15], label))
                n += 1
    odd = [None, [0.0] * 8, [float("nan")] + [1.0] * 7, [None] + [1.0] * 7, [float("inf")] + [1.0] * 7, [], [1.0] * 3, [-0.0] + [1.0] * 7, [0.0] + [1.0] * 7]
    for v in odd:
        rows.append((n, v, 1))
        n += 1
    rows += [rows[0], rows[0]]
    tiny = [2.0**-140, 0.0, 2.0**-141]
    for v in (tiny, [x * 2 for x in tiny], [1.0] * 3, [2.0] * 3, [3e38, 0.0, 1e38], [3e38, 0.0, 1.1e38]):  # of a rarer length, very small and large
        rows.append((n, v, 1))
        n += 1
    good = [(i, np.array(v) / np.abs(v).max(), lab) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links, up = collections.Counter(), {r[0]: r[0] for r in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, (i, v, a) in enumerate(good):
        for y, (j, w, b) in enumerate(good):
            if x != y and a == b and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.93:
                links[x] += 1
                p, q = find(i), find(j)
                up[max(p, q)] = min(p, q)
    want = collections.Counter((i, links[x], find(i)) for x, (i, _, _) in enumerate(good))
    usable = {i for i, _, _ in good}
    want.update((r[0], 0, r[0]) for r in rows if r[0] not in usable)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"rep": F.lit(1), "same": F.lit("x"), "id": F.lit(2)})
    assert collections.Counter(tuple(r)[:3] for r in vectors.near_vectors(df).collect()) == want
    assert vectors.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("leaf", [400, 40])
def test_forest_recall(spark, monkeypatch, leaf):
    """With small leaves the sample allows fewer levels than are needed, so leaves are split again."""
    if leaf < 400:
        for name, v in (("LEAF", leaf), ("LARGE_LEAF", 2 * leaf), ("SAMPLE", 200), ("LEAF_SAMPLE", 300), ("SUBTREE", 2), ("BLOCK", 50)):
            monkeypatch.setattr(vectors, name, v)
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((700, 32))
    x = np.concatenate([c + rng.standard_normal((4, 32)) * 0.2 for c in centres])
    df = spark.createDataFrame([(i, [float(t) for t in v], 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    u = x / np.sqrt((x * x).sum(1))[:, None]
    true = int(((u @ u.T) >= 0.93).sum()) - len(u)
    got = vectors.near_vectors(df).agg(F.sum("n_links")).first()[0]
    assert true > 1000 and 0.95 * true <= got <= true


def test_leaves_are_split_again_with_the_sample_as_it_stands(spark, monkeypatch):
    """A dense group among rows that lie apart, in leaves larger than they may be."""
    for name, v in (("LEAF", 40), ("LARGE_LEAF", 80), ("SAMPLE", 200), ("SUBTREE", 1), ("BLOCK", 50)):
        monkeypatch.setattr(vectors, name, v)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.standard_normal((600, 16)), np.ones(16) + rng.standard_normal((200, 16)) * 0.01])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: tuple(r)[1:3] for r in vectors.near_vectors(df).collect()}
    u = x / np.sqrt((x * x).sum(1))[:, None]
    true = ((u @ u.T) >= 0.93).sum(1) - 1
    assert len(got) == 800 and all(got[i][0] <= true[i] for i in got) and {got[i][1] for i in range(600, 800)} == {600}
    assert sum(n for n, _ in got.values()) >= 0.9 * true.sum()


def test_pairs_of_two_dense_blocks():
    x = np.random.default_rng(5).standard_normal((300, 8)) * 0.01 + 1
    x /= np.sqrt((x * x).sum(1))[:, None]
    a, b = vectors.pairs_above(x, x[:200], 0.93)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == {(i, j) for i in range(300) for j in range(200)} and len(a) == 60_000 > vectors.PAIRS


# 5


def test_warc(spark, tmp_path):
    html = [None, "", "<p>é</p>\r\n\r\n", "same", "same", "x" * 70000, "same", "\x00 odd", ""]
    rows = [(i + 1, f"http://h/{i}" if i % 3 else None, h) for i, h in enumerate(html)]
    rows += [(5, "http://h/4", "same"), (None, "http://n", "null key"), (None, "http://n", "same"), (2, "u", "\u20ac")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"key": F.lit(1), "shard": F.lit(2), "payload": F.lit("z")})
    path = f"file://{tmp_path}/a"
    manifest = warc.write(df, path, file_bytes=60).collect()
    first = {}
    for i, _, h in rows:
        old = first.get(h or "", "none")
        first[h or ""] = i if old in ("none", None) or i is not None and i < old else old
    seen, want = set(), []
    for i, _, h in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2] or "")):
        data = (h or "").encode()
        is_first = first[h or ""] == i and (i, h or "") not in seen
        seen.add((i, h or ""))
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if is_first else "revisit", None if is_first else first[h or ""]))
    got = warc.read(spark, path, with_payload=True)
    assert collections.Counter(map(tuple, got.select("key", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())) == collections.Counter(want)
    assert {r["payload"] for r in got.where("record_type = 'response'").collect()} == {h or "" for _, _, h in rows}
    assert sum(m["records"] for m in manifest) == len(rows) and len(manifest) > 3
    again = warc.write(df.orderBy(F.rand()), f"file://{tmp_path}/b", file_bytes=60).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, manifest))  # byte for byte
    assert warc.write(df.limit(0), f"file://{tmp_path}/c").count() == 0 and warc.read(spark, f"file://{tmp_path}/c").count() == 0


def test_shards_follow_sizes_whatever_the_keys(spark):
    """An outlying key, a key with many payloads and null keys leave no shard above the bound; shards are ranges in order."""
    keys = [*range(2000), 10**15, -(2**63), 2**63 - 1, *[777] * 300, *[None] * 100]
    light = spark.createDataFrame([(k, 100, f"p{i}") for i, k in enumerate(keys)], "key long, size long, same string")
    shards = warc.Shards(light, fewest=1, bounds=(1000, 2000))
    rows = shards.of(light).collect()
    assert len(rows) == len(keys)
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    assert max(len(x) for k, x in by.items() if {r["key"] for r in x} - {777, None}) <= 20 and max(len(x) for x in by.values()) <= 45
    order = [r["key"] for r in sorted(rows, key=lambda r: (r["shard"], r["key"] is not None, r["key"] or 0))]
    assert order == sorted(keys, key=lambda k: (k is not None, k or 0))
    slots = {r["shard"]: r["slot"] for r in rows}
    assert len(set(slots.values())) == len(slots) and max(slots) < shards.count
    assert warc.Shards(light.limit(0)).of(light.limit(0)).count() == 0


# 1


def test_sentencepiece_matches_the_library(spark, docs):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rows = pieces.encode(clashing(docs), hot_units=60).select("doc_id", "text", "ids", "n_pieces", "round_trip").collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r["text"] is None:
            assert r["ids"] is None and r["n_pieces"] is None and r["round_trip"] is None
        else:
            assert list(r["ids"]) == lib.encode(r["text"]) and r["n_pieces"] == len(r["ids"]) and r["round_trip"]
    back = pieces.decode(spark.createDataFrame([(list(r["ids"]) if r["ids"] is not None else None, r["text"]) for r in rows], "ids array<int>, text string")).collect()
    assert all(r["decoded"] == r["text"] for r in back)
    assert pieces.encode(docs.limit(0)).count() == 0


def test_viterbi_fold(spark):
    """A unigram model: the aggregate's segmentation has the best score of all."""
    rng = random.Random(4)
    table = [("<unk>", 0.0, 2)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    table += [(p, -rng.uniform(1, 9), 1) for p in ["▁", "a", "b", "c", "▁a", "ab", "bc", "abc", "ca", "▁ab", "cab", "aa"]]
    m = pieces.Model(table, pieces.UNIGRAM)
    units = sorted({"▁" + "".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(60)})
    made = pieces.encoded_units(spark.createDataFrame([(u,) for u in units], "unit string"), m).collect()
    score = lambda p: m.normal[p][1] if p in m.normal else m.worst

    def best(u):
        if not u:
            return 0.0
        return max(score(u[:k]) + best(u[k:]) for k in range(1, len(u) + 1) if u[:k] in m.normal or k == 1)

    for r in made:
        ps = [p["piece"] for p in r["pieces"]]
        assert "".join(ps) == r["unit"] and abs(sum(map(score, ps)) - best(r["unit"])) < 1e-9
        ids = [i for p in r["pieces"] for i in ([p["id"]] if p["id"] is not None else m.fallback(p["piece"]))]
        assert ids == m.encode_unit(r["unit"])


def test_merge_fold_and_heap_agree():
    m = pieces.model_of(pieces.MODEL)
    rng = random.Random(9)
    for _ in range(200):
        unit = "▁" + "".join(rng.choice("thernandisogé") for _ in range(rng.randint(1, 46)))
        short = m.encode_unit(unit)
        long, pieces.LONG_UNIT = pieces.LONG_UNIT, 0
        try:
            assert m.encode_unit(unit) == short
        finally:
            pieces.LONG_UNIT = long
