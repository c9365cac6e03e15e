r"""Operator 5: WARC archives, written in deterministic shards and read back.

Records are sorted by range of their key into shards whose bounds follow from keys and sizes alone: a histogram of equal ranges, in
which ranges that hold too many bytes are cut again, and a single key with too many by its payloads. A shard's writer rolls to a next
file once the compressed size is reached; headers and digests are made anew. A file is written under a temporary name and renamed, so a
task that is run again replaces its files by equal ones; a manifest of all files is stored last, and readers open the files of the
manifest only, so neither a listing nor the manifest is gathered anywhere.

Equal payloads of at least ``min_bytes`` bytes are stored once: the record with the smallest key is the response, the others are
revisits that refer to it, and of which no payload is shuffled.

Defined cases: a null payload is empty; null keys sort first, and a null key is no target of a revisit unless all keys of
its payload are null; of rows that repeat the smallest key of a payload one is the response and the rest revisit it; a null
url gives an empty target; an empty table gives a manifest without files.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fresh_path, quoted, stored, table

#: Compressed bytes after which a file is closed, ranges that the histogram of keys has, and parts that a too large range is cut into
#: for each shard that it fills.
FILE_BYTES, RANGES, PARTS = 32 << 20, 4096, 4
#: Shards that an archive is dealt over, and the least and most payload bytes of one.
SHARDS, SHARD_BYTES = 64, (4 << 20, 1 << 30)
#: Payloads that occur again are broadcast up to this number (some 80 bytes each), else joined by shuffle.
BROADCAST_PAYLOADS = 500_000
#: Tasks that read an archive at most.
READ_TASKS = 20_000
DATE = "2024-01-01T00:00:00Z"
MIN_BYTES = 0
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def b32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(key: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{key}')}>"


def record(key: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, is_revisit: bool) -> bytes:
    """One gzip member with a response or revisit record; ``size`` and ``digest`` are the payload's, which a revisit leaves out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: {record_id(key)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {''.join(c for c in url or '' if c not in chr(13) + chr(10))}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{b32_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Record-Key: {'' if key is None else key}",
    ]
    if is_revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to)}",
            f"X-Refers-To-Key: {'' if refers_to is None else refers_to}",
            f"X-Payload-Length: {size}",
        ]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive of gzip members."""
    while data:
        pack = zlib.decompressobj(31)
        text = pack.decompress(data) + pack.flush()
        if not pack.eof:
            raise ValueError("the archive is cut off")
        data = pack.unused_data
        head, _, rest = text.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "surrogatepass").split("\r\n")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        block = rest[: int(fields["Content-Length"])]
        if f"sha1:{b32_sha1(block)}" != fields["WARC-Block-Digest"] or rest[len(block) :] != b"\r\n\r\n":
            raise ValueError(f"a broken record {fields['WARC-Record-ID']}")
        yield fields, block


class _Folder:
    """Writes whole files of a folder under temporary names and renames them."""

    def __init__(self, path: str) -> None:
        from pyarrow import fs

        self.fs, self.path = fs.FileSystem.from_uri(path)
        self.fs.create_dir(self.path, recursive=True)

    def put(self, name: str, data: bytes) -> None:
        temporary = f"{self.path}/.{name}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(temporary) as out:
            out.write(data)
        self.fs.move(temporary, f"{self.path}/{name}")


MANIFEST = "shard long, name string, records long, bytes long, sha1 string"


class Shards:
    """Ranges of keys, in order, with about equal sums of sizes: ``of`` gives a row's shard. The driver holds a few numbers for each range:
    RANGES, and PARTS for each shard that a larger range fills."""

    def __init__(self, light: DataFrame, fewest: int = SHARDS, bounds: tuple[int, int] = SHARD_BYTES) -> None:
        self.spark, self.rounds = light.sparkSession, []
        low, high, total, nulls = light.agg(F.min("key"), F.max("key"), F.sum("size"), F.sum(F.when(F.col("key").isNull(), F.col("size")))).first()
        most = min(max((total or 0) // fewest, bounds[0]), bounds[1])
        self.kind = "bigint" if low is None or high - low < 1 << 63 else "decimal(20,0)"
        ranges = {0: (None, 1, nulls or 0)}  # name: lowest key, keys, bytes; the first holds null keys
        todo, name = ({1: (low, high - low + 1, RANGES)} if low is not None else {}), 2
        while todo:
            cuts = {r: (a, -(-n // parts)) for r, (a, n, parts) in todo.items()}
            table = self.spark.createDataFrame([(r, a, step) for r, (a, step) in cuts.items()], "r long, low long, step long")
            sums = self._cut(self._placed(light), table).where("step is not null").groupBy("r", "at").agg(F.sum("size").alias("bytes")).collect()
            children, larger = [], {}
            for x in sorted(sums, key=lambda x: (x["r"], x["at"])):
                a, step = cuts[x["r"]]
                lowest = a + x["at"] * step
                n = min(step, todo[x["r"]][0] + todo[x["r"]][1] - lowest)
                children.append((x["r"], x["at"], name))
                if x["bytes"] > most and n > 1:
                    larger[name] = (lowest, n, PARTS * (x["bytes"] // most + 1))
                else:
                    ranges[name] = (lowest, n, x["bytes"])
                name += 1
            self.rounds.append((table, self.spark.createDataFrame(children, "r long, at long, name long")))
            todo = larger
        out, shard, filled = [], 0, 0
        for r, (_, _, size) in sorted(ranges.items(), key=lambda x: (x[1][0] is not None, x[1][0] or 0)):
            parts = -(-size // most) if size > most else 1  # a single key: dealt by payloads
            if filled and filled + size > most:
                shard, filled = shard + 1, 0
            out.append((r, shard, parts))
            shard, filled = (shard + parts, 0) if parts > 1 else (shard, filled + size)
        self.count = shard + 1
        self.table = self.spark.createDataFrame(out, "r long, first long, parts int")

    def _cut(self, rows: DataFrame, table: DataFrame) -> DataFrame:
        at = F.expr(f"cast((cast(key as {self.kind}) - low) div step as bigint)")
        return rows.join(F.broadcast(table), "r", "left").withColumn("at", at)

    def _placed(self, rows: DataFrame) -> DataFrame:
        names = rows.columns
        rows = rows.withColumn("r", F.when(F.col("key").isNull(), 0).otherwise(1).cast("long"))
        for table, children in self.rounds:
            rows = self._cut(rows, table).join(F.broadcast(children), ["r", "at"], "left").select(*names, F.coalesce("name", "r").alias("r"))
        return rows

    def of(self, rows: DataFrame) -> DataFrame:
        """Adds ``shard`` to rows with key and same, and ``slot``, whose hash puts each shard into a partition of its own."""
        found = self._placed(rows).join(F.broadcast(self.table), "r").withColumn("shard", F.col("first") + F.pmod(F.xxhash64("same"), "parts"))
        ids = self.spark.range(32 * self.count)
        slots = ids.groupBy(F.pmod(F.hash("id"), F.lit(self.count)).cast("long").alias("shard")).agg(F.min("id").alias("slot"))
        return found.join(F.broadcast(slots), "shard", "left").select(*rows.columns, "shard", F.coalesce("slot", F.lit(-1)).alias("slot"))


def plan(pages: DataFrame, key: str, url: str, payload: str, min_bytes: int) -> tuple[DataFrame, int]:
    """((key, url, payload, size, sha1, first, again, same, shard, slot) for each row, number of shards). ``first`` is the key that a
    record of this payload refers to; rows that can only be revisits have a digest instead of a payload."""
    text = F.coalesce(quoted(payload), F.lit(""))
    rows = pages.select(quoted(key).cast("long").alias("key"), quoted(url).alias("url"), text.alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"), "same": F.sha2("payload", 256)})
    light = stored(rows.select("key", "size", "same"), "payloads")
    repeated = light.where(F.col("size") >= min_bytes).groupBy("same").agg(F.min("key").alias("_first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = stored(repeated.select("same", "_first", F.lit(True).alias("_again")), "repeated")
    shards = Shards(light)
    # a payload with many copies is one key of the join: broadcast while there are not too many payloads, then by shuffle
    if repeated.count() <= BROADCAST_PAYLOADS:
        repeated = F.broadcast(repeated)
    rows = shards.of(rows).join(repeated, "same", "left")
    again, first = F.coalesce("_again", F.lit(False)), F.when(F.col("_again"), F.col("_first")).otherwise(F.col("key"))
    only = again & ~F.col("key").eqNullSafe(F.col("_first"))
    return rows.select(
        "key", "url", F.when(~only, F.col("payload")).alias("payload"), "size", F.when(only, F.sha1(F.col("payload").cast("binary"))).alias("sha1"), first.alias("first"), again.alias("again"), "same", "shard", "slot"
    ), shards.count


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = MIN_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the archive below ``path`` (a URI that executors reach) and returns its manifest, stored below it."""
    todo, n = plan(pages, key, url, payload, min_bytes)
    dealt = todo.repartition(n, "slot").sortWithinPartitions("shard", F.col("key").asc_nulls_first(), "same")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, shard, part, out, count, done = None, None, 0, [], 0, []
        written, last = 0, None

        def close() -> None:
            nonlocal part, out, count, written
            if out:
                data, name = b"".join(out), f"part-{shard:06d}-{part:04d}.warc.gz"
                folder.put(name, data)
                done.append((shard, name, count, len(data), hashlib.sha1(data).hexdigest()))
                part, out, count, written = part + 1, [], 0, 0

        for batch in batches:
            folder = folder or _Folder(path)
            for r in batch.to_pylist():
                if r["shard"] != shard:
                    close()
                    shard, part, last = r["shard"], 0, None
                is_first = r["key"] == r["first"] and last != (r["key"], r["same"])
                last = (r["key"], r["same"])
                if r["payload"] is None:
                    data, digest = b"", base64.b32encode(bytes.fromhex(r["sha1"])).decode()
                else:
                    data = r["payload"].encode("utf-8", "surrogatepass")
                    digest = b32_sha1(data)
                out.append(record(r["key"], r["url"], data, r["size"], digest, r["first"], r["again"] and not is_first))
                count, written = count + 1, written + len(out[-1])
                if written >= file_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_pylist([dict(zip(("shard", "name", "records", "bytes", "sha1"), x, strict=True)) for x in done], pa.schema([("shard", pa.int64()), ("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string())]))

    manifest = f"{path}/manifest"
    dealt.select("key", "url", "payload", "size", "sha1", "first", "again", "same", "shard").mapInArrow(run, MANIFEST).write.mode("overwrite").parquet(manifest)
    return pages.sparkSession.read.schema(MANIFEST).parquet(manifest)


READ = "key long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"


def read(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Reads the archive's records; block digests are checked, a response's payload digest is computed anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        schema = pa.schema([("key", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.string())])
        number = lambda x: int(x) if x else None
        store, folder = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name, want in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_stream(f"{folder}/{name}", compression=None) as f:
                    data = f.read()
                if hashlib.sha1(data).hexdigest() != want:
                    raise ValueError(f"{name} is not the file of the manifest")
                out = []
                for head, block in records(data):
                    kind, payload = head["WARC-Type"], block.partition(b"\r\n\r\n")[2]
                    own = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and b32_sha1(payload) != own:
                        raise ValueError(f"a wrong payload digest in {name}")
                    size = int(head["X-Payload-Length"]) if kind == "revisit" else len(payload)
                    text = payload.decode("utf-8", "surrogatepass") if with_payload and kind == "response" else None
                    out.append((number(head["X-Record-Key"]), head["WARC-Target-URI"], size, own, kind, number(head.get("X-Refers-To-Key")), text))
                    if len(out) >= 2000:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema)
                        out = []
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema)

    listed = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").select("name", "sha1")
    # a task opens a few whole files of a bounded size, one after the other
    return listed.repartition(min(max(listed.count(), 1), READ_TASKS), "name").mapInArrow(run, READ)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    return read(spark, path).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS t FROM pages
), d AS (
  SELECT page_id, octet_length(encode(t)) AS payload_bytes, sha1(t) AS hex, min(page_id) OVER (PARTITION BY t) AS first FROM p
), c AS (
  SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || substr(hex, CAST(i * 5 + 1 AS BIGINT), 5) AS BIGINT)) AS v FROM d
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v[i // 4 + 1] >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM c
"""
