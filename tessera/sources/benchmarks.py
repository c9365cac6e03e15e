"""Readers of conversation benchmarks, extractors that cut and remember, and caches beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import chunks, minutes_of
from tessera.sources.storage import exists

INSTANCE = (
    "question_id string, question_type string, question string, answer string, question_date string, haystack_dates array<string>, "
    "haystack_session_ids array<string>, haystack_sessions array<array<struct<role:string,content:string>>>"
)


def instances(spark: SparkSession, path: str) -> DataFrame:
    """Question instances, one row each, from a JSON array."""
    return spark.read.schema(INSTANCE).option("multiLine", True).json(path)


def haystack(rows: DataFrame) -> DataFrame:
    """(question_id, session_id, ts, text): the sessions of each instance in the order of time, turns joined by lines."""
    zipped = F.arrays_zip("haystack_session_ids", "haystack_dates", "haystack_sessions")
    s = rows.select("question_id", F.explode(zipped).alias("s"))
    text = F.array_join(F.transform("s.haystack_sessions", lambda t: F.concat(t["role"], F.lit(": "), t["content"])), "\n")
    return s.select("question_id", F.col("s.haystack_session_ids").alias("session_id"), minutes_of(F.col("s.haystack_dates")).alias("ts"), text.alias("text"))


def conversation(spark: SparkSession, path: str) -> DataFrame:
    """(session, ts, text) from a JSON object with ``conversation.session_N`` lists and ``session_N_date_time``."""
    raw = spark.read.text(path, wholetext=True).select(F.get_json_object("value", "$.conversation").alias("c"))
    keyed = raw.select(F.explode(F.from_json("c", "map<string,string>")).alias("k", "v"))
    sessions = keyed.where(F.col("k").rlike("^session_[0-9]+$")).select(F.regexp_extract("k", "[0-9]+", 0).cast("int").alias("session"), F.from_json("v", "array<struct<speaker:string,text:string>>").alias("turns"))
    dates = keyed.where(F.col("k").rlike("^session_[0-9]+_date_time$")).select(F.regexp_extract("k", "[0-9]+", 0).cast("int").alias("session"), minutes_of(F.col("v")).alias("ts"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["speaker"], F.lit(": "), t["text"])), "\n")
    return sessions.select("session", text.alias("text")).join(dates, "session", "left").select("session", F.coalesce("ts", F.lit(0)).alias("ts"), "text")


def cached(rows: DataFrame, keys: list[str], path: str, compute: Callable[[DataFrame], DataFrame], name: str, kind: str) -> DataFrame:
    """Rows with a column ``name`` that ``compute`` adds, each content of ``keys`` computed only once: a Parquet table under ``path`` holds
    what was found, by digest. What comes out as null failed; it isn't kept and is tried again the next time."""
    spark = rows.sparkSession
    keyed = rows.withColumn("_key", F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys]), 256))
    schema = f"_key string, _out {kind}"
    have = spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
    new = compute(keyed.join(have, "_key", "left_anti").dropDuplicates(["_key"])).select("_key", F.col(name).cast(kind).alias("_out")).where("_out is not null")
    new.write.mode("append").parquet(path)
    have = spark.read.schema(schema).parquet(path).dropDuplicates(["_key"])
    return keyed.drop(*({name} - set(keys))).join(have, "_key", "left").withColumn(name, F.col("_out")).drop("_key", "_out")


def cached_extraction(episodes: DataFrame, path: str, extract: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Episodes with their text extracted, each text and time only once. A text that ``extract`` gives as null yields no facts."""
    return cached(episodes, ["ts", "text"], path, extract, "text", "string").withColumn("text", F.coalesce("text", F.lit("")))


def cached_vectors(facts: DataFrame, path: str, embed: Callable[[Column], Column]) -> DataFrame:
    """(id, text, v): vectors of facts' texts, each text embedded once."""
    return cached(facts.select("id", "text"), ["text"], path, lambda df: df.withColumn("v", embed(F.col("text"))), "v", "array<double>")


def cached_dates(rows: DataFrame, path: str, read: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows (id, text, ...) with ``ymd``, the date that ``read`` finds in a text (YYYYMMDD), each text read once."""
    return cached(rows, ["text"], path, read, "ymd", "bigint")


def memoized(extract: Callable[[DataFrame], DataFrame], path: str) -> Callable[[DataFrame], DataFrame]:
    """An extractor for a memory that remembers what it has extracted."""
    return lambda episodes: cached_extraction(episodes, path, extract)


def chunked(extract: Callable[[DataFrame], DataFrame], target: int = 3500) -> Callable[[DataFrame], DataFrame]:
    """An extractor for a memory that gives long episodes to ``extract`` in pieces of at most ``target`` bytes, cut at line ends; an
    episode's facts are those of its pieces, in order. A piece that fails (null) has none."""

    def run(episodes: DataFrame) -> DataFrame:
        others = [c for c in episodes.columns if c != "text"]
        pieces = episodes.select(*others, F.posexplode(chunks(F.col("text"), target)).alias("_piece", "text"))
        done = extract(pieces).groupBy(*others).agg(F.array_sort(F.collect_list(F.struct("_piece", F.coalesce("text", F.lit("")).alias("text")))).alias("_done"))
        return done.select(*others, F.array_join(F.transform("_done", lambda x: x["text"]), "\n").alias("text")).select(*episodes.columns)

    return run
