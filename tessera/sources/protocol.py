"""Facts from lines of text: ``subject --relation[confidence]--> object``, one a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: words that name nobody in particular
UNRESOLVED = ("i", "me", "my", "mine", "speaker", "user", "they", "them", "he", "she", "it", "we", "you", "that")
MAX_BYTES, MAX_WORDS = 60, 8
_ASCII_SHOWN = r"^[\x21-\x7e]+$"
_NAME = r"^[\p{IsAlphabetic}\p{N}_\-' /.:#]*$"


def _unquoted(text: Column) -> Column:
    t = F.trim(text)
    quoted = (F.length(t) >= 2) & ((F.startswith(t, F.lit('"')) & F.endswith(t, F.lit('"'))) | (F.startswith(t, F.lit("'")) & F.endswith(t, F.lit("'"))))
    return F.when(quoted, F.trim(F.substring(t, F.lit(2), F.length(t) - 2))).otherwise(t)


def entity_problem(name: Column) -> Column:
    """Why a name can't be an entity; null if it can."""
    spaced = name.rlike(r"\s")
    return (
        F.when(F.length(name) == 0, "empty entity name")
        .when(F.lower(name).isin(*UNRESOLVED), "a pronoun or role word: give the entity's name")
        .when((F.octet_length(name) > MAX_BYTES) | (F.size(F.filter(F.split(name, r"\s+"), lambda w: w != "")) > MAX_WORDS), "prose: entity names are short")
        .when(~spaced & ~name.rlike(_ASCII_SHOWN), "characters that aren't printable ASCII in a single token")
        .when(spaced & ~name.rlike(_NAME), "punctuation in a name with spaces")
        .when(spaced & name.rlike(r"[/.:#]"), "a source reference with spaces")
    )


def parse_lines(texts: DataFrame, text: str = "text", default_confidence: float = 0.9) -> DataFrame:
    """One row for each line: the input's other columns, line_no, line, subj, pred, obj, conf and the ``reason`` of a line that
    doesn't parse (else null)."""
    lines = texts.select("*", F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n")).alias("line_no", "raw")).drop(text)
    line = F.trim(F.col("raw"))
    lines = lines.select(*[c for c in texts.columns if c != text], "line_no", line.alias("line")).where("line <> ''")
    subject = F.substring_index("line", "--", 1)
    rest = F.substring(F.col("line"), F.length(subject) + 3, F.length("line"))
    relation, arrow = F.substring_index(rest, "-->", 1), F.instr(rest, "-->")
    parsed = lines.withColumns({"_s": subject, "_rest": rest, "_rel": F.trim(relation), "_obj": F.when(arrow > 0, F.substring(rest, arrow + 3, F.length(rest)))})
    suffix = F.col("_rel").contains("[") & F.endswith(F.col("_rel"), F.lit("]"))
    name = F.when(suffix, F.trim(F.regexp_extract("_rel", r"(?s)^(.*)\[", 1))).otherwise(F.col("_rel"))
    conf = F.when(suffix, F.regexp_extract("_rel", r"(?s)^.*\[(.*?)\]*$", 1)).cast("string")
    parsed = parsed.withColumns({"subj": _unquoted(F.col("_s")), "pred": name, "obj": _unquoted(F.col("_obj")), "conf": F.coalesce(F.trim(conf).try_cast("double"), F.lit(default_confidence))})
    reason = F.when(~F.col("line").contains("--"), "no --relation--> structure").when(F.col("_obj").isNull(), "-- without -->").when(F.col("pred") == "", "empty relation")
    return parsed.withColumn("reason", reason).drop("_s", "_rest", "_rel", "_obj")


def parse_strict(texts: DataFrame, text: str = "text", default_confidence: float = 0.9) -> DataFrame:
    """``parse_lines`` with names and relations checked: what a model wrote is a fact only if it is clean."""
    rows = parse_lines(texts, text, default_confidence)
    relation = F.when(~F.col("pred").rlike("^[a-z0-9_]+$"), "a relation is snake_case")
    return rows.withColumn("reason", F.coalesce("reason", entity_problem(F.col("subj")), entity_problem(F.col("obj")), relation))


def good(rows: DataFrame) -> DataFrame:
    return rows.where("reason is null").drop("reason")


def dropped(rows: DataFrame) -> DataFrame:
    return rows.where("reason is not null").select(*[c for c in rows.columns if c not in ("subj", "pred", "obj", "conf")])


def typed_object(obj: Column) -> Column:
    """Digits (with a sign) that fit 64 bits become an integer, all else stays a symbol."""
    number = F.when(obj.rlike(r"^[+-]?[0-9]+$"), obj.try_cast("bigint"))
    return F.struct(number.alias("i"), F.when(number.isNull(), obj).alias("s"))
