r"""Operator 9: personal data in whole texts.

Regular expressions propose spans, validators (ranges, Luhn, mod-97, mod-23) confirm them, and words in front of a span raise or
lower its score. Of the kinds that the method adds (iban, nir, dni, ssn, secret) those stay whose score reaches ACCEPTED: what a
checksum confirms needs no word beside it, what only has a form does, and a word that speaks against it rejects either. The base
kinds (email, ip, card, phone) stay whatever their score; ``redacted`` may leave those of a low one alone.
Only DataFrame functions are used. A span's place follows from what a split by the same expression leaves between hits.

The base expressions are those of the contract, written so that Java's engine neither rescans a run nor recurses: a run may
start only where no character of its kind stands before it, or where the last hit ended (``\G``), and loops are possessive.

Defined cases: null and empty texts hold nothing; repeated rows are searched and returned each; an empty table gives an
empty result; other columns are kept by ``personal_data`` but those whose names it gives to its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import let, own, quoted, table

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "nir", "dni", "ssn", "secret")
KINDS = BASE_KINDS + ADDED_KINDS
#: What a national number looks like inside a run of letters and digits; a French one has sex, year, month, place and a key.
FORMS = {"nir": "[12][0-9]{2}(?:0[1-9]|1[0-2])[0-9]{10}", "dni": "[0-9]{8}[A-Z]", "ssn": "[0-9]{3}-[0-9]{2}-[0-9]{4}", "secret": "[0-9a-f]{32,64}"}
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)",
    **{k: rf"(?<![0-9A-Za-z]){FORMS[k]}(?![0-9A-Za-z])" for k in ("nir", "dni", "secret")},
    "ssn": rf"(?<![0-9-]){FORMS['ssn']}(?![0-9-])",
}
#: Score of a confirmed span; words that raise or lower it when they stand in the CONTEXT characters before it, and by how much.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.6, "nir": 0.5, "dni": 0.3, "ssn": 0.3, "secret": 0.2}
CONTEXT_WORDS = {
    "email": ("mail", "contact"),
    "ip": ("ip", "address", "host"),
    "card": ("card", "visa", "payment"),
    "phone": ("phone", "tel", "call"),
    "iban": ("iban", "account", "bank"),
    "nir": ("insee", "nir", "social"),
    "dni": ("dni", "nif", "identidad"),
    "ssn": ("ssn", "social security", "tax id"),
    "secret": ("token", "secret", "key", "passw", "auth", "credential"),
}
AGAINST_WORDS = {
    **dict.fromkeys(("email", "card", "phone", "iban", "nir", "dni", "ssn"), ("example", "sample", "dummy")),
    "ip": ("version", "release", "section"),
    "secret": ("commit", "checksum", "sha1", "sha256", "md5", "digest", "etag"),
}
CONTEXT, RAISED_BY, LOWERED_BY, ACCEPTED = 40, 0.4, 0.4, 0.5
CHUNK = 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"  # fixed value: check letters by the remainder


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number without blanks has the remainder 1."""
    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, F.lit(1), F.lit(4)))

    def add(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), add) == 1


def at_most_255(part: Column) -> Column:
    return let(F.regexp_replace(part, "^0+", ""), lambda p: (F.length(p) == 0) | F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(False))


def confirmed(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), at_most_255)
    if kind == "card":
        return F.when(F.length(hit) < 13, False).otherwise(
            let(F.translate(hit, " -", ""), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False))
        )
    if kind == "phone":
        return F.length(F.regexp_replace(hit, "[^0-9]", "")).between(9, 15)
    if kind == "iban":
        return let(F.translate(hit, " ", ""), lambda x: F.length(x).between(15, 34) & mod97(x))
    number = lambda a, n: F.substring(hit, a, n).cast("bigint")
    if kind == "nir":
        return 97 - number(1, 13) % 97 == number(14, 2)
    if kind == "dni":
        return F.substring(F.lit(DNI_LETTERS), (number(1, 8) % 23 + 1).cast("int"), F.lit(1)) == F.substring(hit, 9, 1)
    if kind == "ssn":
        return ~F.substring(hit, 1, 3).isin("000", "666") & (F.substring(hit, 1, 1) != "9") & (F.substring(hit, 5, 2) != "00") & (F.substring(hit, 8, 4) != "0000")
    if kind == "secret":  # letters and digits
        return hit.rlike("[0-9]") & hit.rlike("[a-f]")
    return F.lit(True)


def stands_alone(text: Column, x: Column) -> Column:
    """Whether no letter or digit stands at either side of a span."""
    beside = lambda at: F.coalesce(F.substring(text, at, F.lit(1)).rlike("[0-9A-Za-z]"), F.lit(False))
    return ~(F.when(x["start"] > 0, beside(x["start"])).otherwise(F.lit(False)) | beside(x["end"] + 1))


def spans_of(kind: str, text: Column) -> Column:
    """Array of struct(start, end, score) of the confirmed and accepted spans of a kind, in order."""
    pattern = PATTERNS[kind]
    none = F.expr("cast(array() as array<struct<start:int,end:int,score:double>>)")

    def placed(hits: Column) -> Column:
        # what precedes a hit, in chunks: places add up inside chunks from the chunks' own offsets, in linear time
        parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"))
        sized = F.transform(
            F.filter(parts, lambda x: x["hit"].isNotNull()), lambda x: F.struct(F.length(x["gap"]).alias("g"), F.length(x["hit"]).alias("n"), x["hit"].alias("hit"))
        )
        zero = F.expr("named_struct('at', 0, 'out', cast(array() as array<int>))")

        def starts(chunk: Column, offset: Column) -> Column:
            return F.aggregate(
                chunk,
                F.struct(offset.alias("at"), zero["out"].alias("out")),
                lambda a, x: F.struct((a["at"] + x["g"] + x["n"]).alias("at"), F.array_append(a["out"], a["at"] + x["g"]).alias("out")),
                lambda a: a["out"],
            )

        def by_chunk(chunks: Column) -> Column:
            sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x["g"] + x["n"]))
            offsets = F.aggregate(
                sums,
                F.struct(F.lit(0).alias("at"), zero["out"].alias("out")),
                lambda a, x: F.struct((a["at"] + x).alias("at"), F.array_append(a["out"], a["at"]).alias("out")),
                lambda a: a["out"],
            )
            return let(
                offsets,
                lambda o: F.flatten(
                    F.transform(
                        chunks, lambda c, i: F.zip_with(c, starts(c, F.get(o, i)), lambda x, s: F.struct(s.alias("start"), (s + x["n"]).alias("end"), x["hit"].alias("hit")))
                    )
                ),
            )

        return let(
            sized,
            lambda z: let(F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / CHUNK).cast("int")), lambda i: F.slice(z, i * CHUNK + 1, F.lit(CHUNK))), by_chunk),
        )

    def scored(x: Column) -> Column:
        first = F.greatest(x["start"] - CONTEXT, F.lit(0))
        before = F.translate(F.substring(text, first + 1, x["start"] - first), UPPER, LOWER)

        def says(words: tuple[str, ...]) -> Column:
            return F.when(before.rlike("|".join(words)), 1.0).otherwise(0.0)

        score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(SCORES[kind]) + RAISED_BY * says(CONTEXT_WORDS[kind]) - LOWERED_BY * says(AGAINST_WORDS[kind])))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), score.alias("score"))

    def found(hits: Column) -> Column:
        good = F.filter(placed(hits), lambda x: confirmed(kind, x["hit"]))
        if kind == "iban":
            good = F.filter(good, lambda x: stands_alone(text, x))
        good = F.transform(good, scored)
        if kind in ADDED_KINDS:
            good = F.filter(good, lambda x: x["score"] >= ACCEPTED)
        # no place is computed where no hit can pass
        return F.when(F.exists(hits, lambda h: confirmed(kind, h)), good).otherwise(none)

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    may = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")), "ssn": F.contains(text, F.lit("-"))}.get(kind)
    spans = let(hits, found)
    return spans if may is None else F.when(may, spans).otherwise(none)


def personal_data(docs: DataFrame, text: str = "text", prefix: str = "pii_") -> DataFrame:
    """Adds an array column of struct(start, end, score) for each kind, named by prefix and kind, in place of columns of that name."""
    t = F.coalesce(quoted(text), F.lit(""))
    names = {kind: f"{prefix}{kind}" for kind in KINDS}
    return docs.select(*own(docs, *names.values()), *[spans_of(kind, t).alias(name) for kind, name in names.items()])


def joined(kinds: tuple[str, ...], prefix: str = "pii_") -> Column:
    def shown(kind: str) -> Column:
        return F.transform(F.col(f"{prefix}{kind}"), lambda x: F.concat(F.lit(f"{kind}:"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string")))

    return F.array_join(F.concat(*[shown(k) for k in kinds]), ",")


def redacted(text: Column, prefix: str = "pii_", least: float = 0.0) -> Column:
    """The text with each span of a score of ``least`` or more replaced by its kind in angle brackets; of overlapping spans the first
    names the place."""

    def tagged(kind: str) -> Column:
        spans = F.col(f"{prefix}{kind}")
        spans = F.filter(spans, lambda x: x["score"] >= least) if least > 0 else spans
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(f"<{kind.upper()}>").alias("tag")))

    every = F.concat(*[tagged(k) for k in KINDS])

    def put(a: Column, x: Column) -> Column:
        fresh = F.concat(a["out"], F.substring(text, a["at"] + 1, x["start"] - a["at"]), x["tag"])
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.when(x["start"] >= a["at"], fresh).otherwise(a["out"]).alias("out"))

    def filled(spans: Column) -> Column:
        return F.aggregate(
            spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), put, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text)))
        )

    return let(F.array_sort(every), lambda s: F.when(F.size(s) > 0, filled(s)).otherwise(text))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = joined(BASE_KINDS)
    return rows.select(
        "doc_id",
        *[F.size(f"pii_{k}").cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(base, 256).alias("base_sha256"),
        joined(KINDS).alias("spans"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans are replaced by their kinds; n_chars follows the new text. A null text stays null."""
    prefix = "pii_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    rows = personal_data(docs, prefix=prefix).withColumn("text", redacted(F.col("text"), prefix)).select(*own(docs))
    return rows.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def _sql_spans(kind: str, pattern: str, passes: str) -> str:
    return f"""
SELECT doc_id, '{kind}' AS kind, i, start, start + length(hit) AS stop, hit, t FROM (
  SELECT doc_id, i, hit, t, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i) - length(hit) AS BIGINT) AS start FROM (
    SELECT doc_id, t, unnest(range(1, len(hits) + 1)) AS i, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap FROM (
      SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS hits, regexp_split_to_array(t, '{pattern}') AS gaps FROM d)))
WHERE {passes}"""


_DIGITS = "regexp_replace(hit, '[^0-9]', '', 'g')"
_COMPACT = "replace(hit, ' ', '')"
_MOVED = f"substr({_COMPACT}, 5) || left({_COMPACT}, 4)"
_REMAINDER = (
    f"list_reduce(list_prepend(0, list_transform(string_split({_MOVED}, ''), lambda c: CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE ascii(c) - 48 END)), "
    "lambda r, v: (r * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97)"
)


def _sql_score(kind: str) -> str:
    said = lambda words: f"CASE WHEN regexp_matches(before, '{'|'.join(words)}') THEN 1.0 ELSE 0.0 END"
    return f"{SCORES[kind]}e0 + {RAISED_BY}e0 * {said(CONTEXT_WORDS[kind])} - {LOWERED_BY}e0 * {said(AGAINST_WORDS[kind])} >= {ACCEPTED}e0"


def _sql_added(kind: str, pattern: str, passes: str) -> str:
    """Spans of an added kind: proposed as whole runs, since this SQL's expressions can't look around."""
    return f"""
SELECT doc_id, kind, i, start, stop, hit, t FROM (
  SELECT *, translate(t[greatest(start - {CONTEXT}, 0) + 1:start], '{UPPER}', '{LOWER}') AS before FROM ({_sql_spans(kind, pattern, passes)}))
WHERE {_sql_score(kind)}"""


SQL = (
    r"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ("
    + " UNION ALL ".join(
        [
            _sql_spans("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
            _sql_spans(
                "ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(hit, '.'), lambda p: CAST(p AS HUGEINT) > 255)) = 0"
            ),
            _sql_spans(
                "card",
                r"[0-9](?:[\x20-]?[0-9])+",
                f"length({_DIGITS}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda k: "
                f"CASE WHEN k % 2 = 1 THEN CAST({_DIGITS}[length({_DIGITS}) - k + 1] AS INT) "
                f"ELSE (CAST({_DIGITS}[length({_DIGITS}) - k + 1] AS INT) * 2) // 10 + (CAST({_DIGITS}[length({_DIGITS}) - k + 1] AS INT) * 2) % 10 END)) % 10 = 0",
            ),
            _sql_spans("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
            _sql_added(
                "iban",
                PATTERNS["iban"],
                f"length({_COMPACT}) BETWEEN 15 AND 34 AND {_REMAINDER} = 1 AND NOT regexp_matches(CASE WHEN start > 0 THEN t[start] ELSE '' END || t[start + length(hit) + 1], '[0-9A-Za-z]')",
            ),
            _sql_added("nir", "[0-9A-Za-z]+", f"regexp_full_match(hit, '{FORMS['nir']}') AND 97 - TRY_CAST(left(hit, 13) AS BIGINT) % 97 = TRY_CAST(hit[14:15] AS BIGINT)"),
            _sql_added("dni", "[0-9A-Za-z]+", f"regexp_full_match(hit, '{FORMS['dni']}') AND substr('{DNI_LETTERS}', TRY_CAST(left(hit, 8) AS BIGINT) % 23 + 1, 1) = right(hit, 1)"),
            _sql_added("ssn", "[0-9-]+", f"regexp_full_match(hit, '{FORMS['ssn']}') AND left(hit, 3) NOT IN ('000', '666') AND hit[1] <> '9' AND hit[5:6] <> '00' AND hit[8:11] <> '0000'"),
            _sql_added("secret", "[0-9A-Za-z]+", f"regexp_full_match(hit, '{FORMS['secret']}') AND regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[a-f]')"),
        ]
    )
    + f"""), a AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 'email') AS n_email, count(*) FILTER (WHERE kind = 'ip') AS n_ip,
    count(*) FILTER (WHERE kind = 'card') AS n_card, count(*) FILTER (WHERE kind = 'phone') AS n_phone,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY list_position({list(KINDS)}, kind), start) FILTER (WHERE kind IN {BASE_KINDS}) AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY list_position({list(KINDS)}, kind), start) AS spans
  FROM s GROUP BY doc_id
)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
"""
)
