"""Path templates against a plain version in Python, and with labels held out."""

import collections
import random
import re

from pyspark.sql import functions as F

from tessera.llm import urls


def brute(pages, labels):
    """{id: rejected} of pages (id, host, segments) and labels {id: bad}."""
    n = lambda rows: (len(rows), sum(r[0] in labels for r in rows), sum(labels.get(r[0], False) for r in rows))
    kind = lambda r, i: "end" if len(r[2]) <= i else "variable" if r[2][i] == "*" else "word"
    under = collections.defaultdict(list)
    for r in pages:
        for i in range(len(r[2]) + 1):
            under[r[1], tuple(r[2][:i])].append(r)

    def star(host, node):
        mine, up = under[host, node], under[host, node[:-1]]
        up = [r for r in up if len(r[2]) >= len(node)]
        apart = sum(abs(sum(kind(r, len(node)) == k for r in mine) / len(mine) - sum(kind(r, len(node)) == k for r in up) / len(up)) for k in ("end", "variable", "word")) / 2
        _, l, b = n(mine)
        _, pl, pb = n(up)
        p = pb / pl if pl else 0
        return apart <= urls.ALIKE * (1 / len(mine)) ** 0.5 / 2 and (not l or abs(b / l - p) <= urls.ALIKE * (p * (1 - p) / l) ** 0.5)

    template = {r[0]: tuple("*" if star(r[1], tuple(r[2][:i])) else r[2][i - 1] for i in range(1, len(r[2]) + 1)) for r in pages}
    parts = collections.defaultdict(list)
    for r in pages:
        for i in range(1, len(r[2]) + 1):
            parts[r[1], template[r[0]][:i]].append(r)
    _, l, b = n(pages)
    mean, out = b / max(l, 1), {}
    for r in pages:
        out[r[0]] = False
        for i in range(len(r[2]), 0, -1):
            size, l, b = n(parts[r[1], template[r[0]][:i]])
            if l >= urls.MIN_LABELLED:
                w = urls.PRIOR_WEIGHT + urls.UNLABELLED_WEIGHT * (size - l)
                out[r[0]] = (b + w * mean) / (l + w) >= urls.MIN_PURITY
                break
    return out


def test_trees_of_any_depth_agree_with_a_plain_version(spark):
    rng = random.Random(8)
    words = ["ads", "news", "forum", "user", "spam", "a", "b", "img"]
    pages, labels = [], {}
    for i in range(1500):
        segs = [rng.choice(words[: 3 + d]) if rng.random() < 0.7 else str(rng.randrange(10**6)) for d in range(rng.randint(0, 6))]
        pages.append((i, f"http://h{rng.randrange(3)}.xyz/" + "/".join(segs) + rng.choice(["", "?q", "#t"])))
        if rng.random() < 0.4:
            labels[i] = "ads" in segs or "spam" in segs
    pages += [(9000, "http://h1.xyz/" + "deep/" * 900), (9001, "http://h1.xyz//"), (9002, "http://h1.xyz"), (9003, None)]
    df = spark.createDataFrame(pages, "page_id long, url string").withColumns({c: F.lit(1) for c in ("host", "segs", "leaf", "n", "l", "b", "_r", "_id", "_bad", "rule")})
    got = {r["page_id"]: r["template_rejected"] for r in urls.url_filter(df, labels=spark.createDataFrame(list(labels.items()), "page_id long, bad boolean")).collect()}
    cut = lambda u: ["*" if re.match(urls.VARIABLE, s) else s for s in re.sub("[?#].*", "", u.split("//", 1)[1]).split("/")[1:] if s]
    plain = [(i, u.split("/")[2], cut(u)) for i, u in pages if u]
    assert got == brute(plain, labels) | {9003: False} and 0 < sum(got.values()) < len(got)


def test_unlabelled_branches_take_the_verdict_of_what_they_merge_with(spark):
    pages = [(i, f"http://h.xyz/{kind}/{i}") for i, kind in enumerate(["de"] * 30 + ["en"] * 30)]
    pages += [(100 + i, f"http://h.xyz/docs/part/of/{'abcde'[i % 5]}") for i in range(30)]
    labels = spark.createDataFrame([(i, True) for i in range(30)] + [(100 + i, False) for i in range(10)], "page_id long, bad boolean")
    out = urls.url_filter(spark.createDataFrame(pages, "page_id long, url string"), labels=labels)
    # en follows the same pattern as de, docs doesn't
    assert {(r["path"].split("/")[1], r["verdict"]) for r in out.collect()} == {("de", "block"), ("en", "block"), ("docs", "allow")}


def test_held_out_labels(spark):
    """Half of the labels judge the other half: blocked sections under user ids, clean ones beside them."""
    rng = random.Random(3)
    pages, bad = [], {}
    for i in range(3000):
        section = rng.choice(["spam", "shop", "posts", "about"])
        pages.append((i, f"https://f{rng.randrange(4)}.xyz/forum/user/{rng.randrange(500)}/{section}/{rng.randrange(99)}"))
        bad[i] = section == "spam"
    seen = spark.createDataFrame([(i, b) for i, b in bad.items() if i % 2], "page_id long, bad boolean")
    got = {r["page_id"]: r["verdict"] == "block" for r in urls.url_filter(spark.createDataFrame(pages, "page_id long, url string"), labels=seen).collect()}
    held = [i for i in bad if i % 2 == 0]
    caught = sum(got[i] for i in held if bad[i]) / sum(bad[i] for i in held)
    wrong = sum(got[i] for i in held if not bad[i]) / sum(not bad[i] for i in held)
    assert caught > 0.9 and wrong < 0.05
