"""Text functions as column expressions: tokens, stems, overlap, scores and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the stop words and irregular forms that retrieval is defined with
STOP_WORDS = (
    "a", "an", "the", "at", "in", "on", "of", "to", "is", "are", "was", "were", "be", "do", "does", "did", "who", "what", "which", "for",
    "with", "and",
)
IRREGULAR = {
    "flew": "fly", "flying": "fly", "flown": "fly", "took": "take", "taking": "take", "taken": "take", "went": "go", "going": "go", "gone": "go",
    "bought": "buy", "buying": "buy", "got": "get", "getting": "get", "ate": "eat", "ran": "run", "stayed": "stay", "moved": "move", "watched": "watch",
}
# fixed values: words that scoring of answers leaves out
SCORE_STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "to", "of", "in", "on", "and", "or", "for", "with", "it", "its",
)
# fixed values: month names
MONTHS = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
)
NOT_WORD = r"[^\p{IsAlphabetic}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda t: t != "")


def norm_token(token: Column) -> Column:
    """Irregular verb forms to their base; plurals of more than four bytes lose their s."""
    out = F.when((F.octet_length(token) > 4) & F.endswith(token, F.lit("s")) & ~F.endswith(token, F.lit("ss")), F.substring(token, F.lit(1), F.length(token) - 1)).otherwise(token)
    table = F.create_map(*[F.lit(x) for pair in IRREGULAR.items() for x in pair])
    return F.coalesce(F.try_element_at(table, token), out)


def tokens(text: Column) -> Column:
    """Normalized tokens of more than one byte that aren't stop words, in order."""
    kept = F.filter(words(text), lambda t: (F.octet_length(t) > 1) & ~t.isin(*STOP_WORDS))
    return F.transform(kept, norm_token)


def stem(token: Column) -> Column:
    """Lenient plural stem: any token of three bytes or more loses a single final s."""
    plural = (F.octet_length(token) >= 3) & F.endswith(token, F.lit("s")) & ~F.endswith(token, F.lit("ss"))
    return F.when(plural, F.substring(token, F.lit(1), F.length(token) - 1)).otherwise(token)


def stems(text: Column) -> Column:
    """The set of stemmed tokens, sorted."""
    return F.array_sort(F.array_distinct(F.transform(tokens(text), stem)))


def topic_overlap(line_stems: Column, subject: Column, query_stems: Column) -> Column:
    """How many stems of a fact's line, other than its subject's own, the query shares; long ones also by prefix."""
    own = stems(subject)

    def near(t: Column, q: Column) -> Column:
        return (q == t) | ((F.octet_length(q) >= 4) & (F.octet_length(t) >= 4) & (F.startswith(q, t) | F.startswith(t, q)))

    hits = F.filter(line_stems, lambda t: (F.octet_length(t) >= 3) & ~F.array_contains(own, t) & F.exists(query_stems, lambda q: near(t, q)))
    return F.size(hits)


def strip_thinking(text: Column) -> Column:
    """A model's answer without its <think> blocks, closed or not."""
    return F.trim(F.regexp_replace(text, r"(?s)<think>.*?(?:</think>|\z)", ""))


def score_tokens(text: Column) -> Column:
    return F.filter(words(text), lambda t: ~t.isin(*SCORE_STOP_WORDS))


def token_f1(prediction: Column, gold: Column) -> Column:
    """Token F1 of two texts; two empty ones agree."""
    p, g = score_tokens(prediction), score_tokens(gold)
    count = lambda xs, t: F.size(F.filter(xs, lambda x: x == t))
    hits = F.aggregate(F.array_distinct(p), F.lit(0), lambda a, t: a + F.least(count(p, t), count(g, t)))
    f1 = 2.0 * hits / (F.size(p) + F.size(g))
    return F.when((F.size(p) == 0) & (F.size(g) == 0), F.lit(1.0)).when((F.size(p) == 0) | (F.size(g) == 0), F.lit(0.0)).otherwise(f1)


def exact_match(prediction: Column, gold: Column) -> Column:
    return score_tokens(prediction) == score_tokens(gold)


def date_to_int(text: Column) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD as YYYYMMDD with zeros for missing parts; else null."""
    part = lambda n: F.regexp_extract(text, r"^([0-9]{4})(?:-([0-9]{2})(?:-([0-9]{2}))?)?$", n)
    number = lambda n: F.coalesce(F.nullif(part(n), F.lit("")).cast("bigint"), F.lit(0))
    return F.when(text.rlike(r"^[0-9]{4}(-[0-9]{2}(-[0-9]{2})?)?$"), number(1) * 10000 + number(2) * 100 + number(3))


def days_of(ymd: Column) -> Column:
    """Days since 1970-01-01 of a YYYYMMDD integer; missing parts count as the first."""
    year, month, day = F.floor(ymd / 10000).cast("int"), F.floor(ymd / 100).cast("int") % 100, (ymd % 100).cast("int")
    first = F.make_date(year, F.greatest(month, F.lit(1)), F.lit(1))
    return F.datediff(F.date_add(first, F.greatest(day, F.lit(1)) - 1), F.lit("1970-01-01").cast("date")).cast("bigint")


def minutes_of(text: Column) -> Column:
    """``YYYY/MM/DD (Dow) HH:MM`` or ``h:mm pm on D Month, YYYY`` as minutes that grow with time but follow no calendar."""
    num = lambda pattern, n: F.coalesce(F.nullif(F.regexp_extract(text, pattern, n), F.lit("")).cast("bigint"), F.lit(0))
    slashed = r"^\s*([0-9]+)/([0-9]+)/([0-9]+)(?:.*?\s([0-9]+):([0-9]+))?"
    a = ((num(slashed, 1) * 366 + num(slashed, 2) * 31 + num(slashed, 3)) * 24 + num(slashed, 4)) * 60 + num(slashed, 5)
    spoken = r"(?i) on ([0-9]+),?\s+([a-z]+),?\s+([0-9]+)"
    month = F.lower(F.regexp_extract(text, spoken, 2))
    at = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), month)
    b = (num(spoken, 3) * 366 + F.greatest(at, F.lit(1)) * 31 + num(spoken, 1)) * 24 * 60
    return F.when(text.rlike(slashed), a).when(text.rlike(spoken), b).otherwise(F.lit(0).cast("bigint"))


def chunks(text: Column, target: int = 3500) -> Column:
    """A text cut at line ends into pieces of at most ``target`` bytes; a longer line is a piece of its own."""

    def step(a: Column, line: Column) -> Column:
        last = F.element_at(a, -1)
        fits = F.octet_length(last) + F.octet_length(line) + 1 <= target
        grown = F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.concat(last, F.lit("\n"), line)))
        return F.when(F.size(a) == 0, F.array(line)).when(fits, grown).otherwise(F.array_append(a, line))

    return F.aggregate(F.split(text, "\n"), F.expr("cast(array() as array<string>)"), step)


def is_counting_question(question: Column) -> Column:
    """Whether a question asks for a number of things, a total, or what has most or least."""
    return F.lower(question).rlike(r"\b(how many|how much|number of|count of|total|in all|altogether)\b| (most|least) ")


def names_subject(subject: Column, question: Column) -> Column:
    """Whether a question has one of a subject's name's tokens (of three bytes or more) as a whole token."""
    asked = words(question)
    return F.exists(words(subject), lambda t: (F.octet_length(t) >= 3) & F.array_contains(asked, t))
