"""Whole license files, wrapped headers, prose about licenses, and a plain search over all spans of a text."""

import random
import textwrap

import pytest

from tessera.llm import licenses as L


def longest(name):
    return max((t for n, t in L.TEMPLATES if n == name), key=len)


def found(text):
    return [(name, text[a:b]) for a, b, (name, _, _, good) in L.scan(text) if good]


def file_of(name, title, breaks):
    """A license's text as its file has it: title, holder, paragraphs, lines of 78 characters."""
    text = longest(name)
    for b in breaks:
        text = text.replace(b, "\n\n" + b)
    return f"{title}\n\nCopyright (c) 2019-2023, Jane Q. Doe and others\nAll rights here stay with Jane.\n\n" + "\n\n".join(textwrap.fill(p, 78) for p in text.split("\n\n")) + "\n"


@pytest.mark.parametrize(
    ("name", "title", "breaks"),
    [
        ("MIT", "The MIT License", ["The above", "THE SOFTWARE IS"]), ("BSD-2-Clause", "BSD 2-Clause License", ["1. ", "2. ", "THIS SOFTWARE"]),
        ("BSD-3-Clause", "BSD 3-Clause License", ["1. ", "2. ", "3. ", "THIS SOFTWARE"]), ("ISC", "ISC License", ["THE SOFTWARE IS"]), ("Unlicense", "", ["Anyone is"]),
    ],
)
def test_whole_files(name, title, breaks):
    got = found(file_of(name, title, breaks))
    assert name in [n for n, _ in got]
    span = next(t for n, t in got if n == name)
    assert L.differences(L.wording(span), L.wording(longest(name))) == []


@pytest.mark.parametrize("front", ["// ", " * ", "# ", "-- ", ""])
@pytest.mark.parametrize("name", ["Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0"])
def test_wrapped_headers(name, front):
    text = "#!/bin/x\n" + f"{front}Copyright 2020 Someone Inc.\n{front}\n" + "\n".join(front + x for x in textwrap.wrap(longest(name), 68)) + f"\n{front}\n\nint main() {{}}\n"
    assert [n for n, _ in found(text)] == [name]


def test_changed_words_are_differences():
    words = longest("MIT").replace("free of charge", "for a fee").split(" ")
    (got,) = [w for _, _, w in L.scan(" ".join(words)) if w[3]]
    assert got[0] == "MIT" and set(got[2]) >= {"+fee", "-free", "-charge"}
    assert not found(" ".join(w for i, w in enumerate(words) if i % 4))  # a quarter is missing


PROSE = [
    "You need a licence to drive a car. The licence is issued by the state and must be renewed; copyright has nothing to do with it.",
    "Permission to enter the garden is granted to any person who asks for it, free of charge, subject to the weather.",
    "The warranty is limited to two years. Without a receipt no warranty is given, and merchantability is not a word in this house.",
    "Software licenses such as those of the free software movement permit redistribution. Most of them ask that the copyright notice be kept.",
    "All rights of the tenants are reserved by law, she said; this program is free, and you can change it.",
]


def test_prose_about_licenses_is_not_confirmed():
    assert [found(p) for p in PROSE] == [[]] * len(PROSE) and found("\n".join(PROSE)) == []


def test_every_template_has_cues():
    for _, text in L.TEMPLATES:
        assert any(c in w for c in L.CUES for w in L.wording(text)), text


def spans_by_force(text):
    """Licenses of which some span of the text, whatever it is, has the wording."""
    words, out = L.wording(text), set()
    for name, template in L.TEMPLATES:
        want = L.wording(template)
        slack = int(L.MAX_DIFFERENCE * len(want))
        for i in range(len(words)):
            for n in range(max(1, len(want) - slack), len(want) + slack + 1):
                if i + n <= len(words) and len(set(want) - set(words[i : i + n])) <= slack and len(L.differences(words[i : i + n], want)) <= L.MAX_DIFFERENCE * len(want):
                    out.add(name)
    return out


def test_no_span_is_missed():
    rng = random.Random(5)
    fill = "the of stone river and a house when over light under some with more field".split()
    short = [(n, t) for n, t in L.TEMPLATES if 5 <= len(L.wording(t)) <= 45]
    for name, template in short:
        words = template.split(" ")
        for edits in (0, int(L.MAX_DIFFERENCE * len(words) / 2)):
            changed = list(words)
            for k in rng.sample(range(1, len(words)), edits):
                changed[k] = rng.choice(fill)
            body = " ".join([*rng.choices(fill, k=rng.randrange(9)), *changed, *rng.choices(fill, k=rng.randrange(9))])
            text = rng.choice([body, textwrap.fill(body, 40)])
            want, got = spans_by_force(text), {n for n, _ in found(text)}
            # templates that are parts of each other, or differ in a number, name one notice; the scan reports the closest
            assert got <= want and bool(got) == bool(want), (name, text, want, got)
