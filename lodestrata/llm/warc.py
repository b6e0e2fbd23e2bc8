"""WARC archives and their chunked record table.

A payload longer than a segment is written as WARC segments (the record and its continuations), each cut from the
payload in a row of its own, so that neither the writer's lines nor the reader's rows ever hold more than a segment. The
reader gives one row per segment: record, chunk number, bytes. Digests of long payloads are carried from chunk to chunk.

Archives are written and read by Spark's text source with the record boundary as its line separator, hence by any store
that Spark reaches, and are split among tasks like any text. Each record's first header names the archive's warcinfo
record by a random number drawn when it is written; the boundary holds it, so that no payload can hold a boundary.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import new_path, small, store

#: Bytes of a segment.
SEGMENT = 1 << 20
VERSION, LINE, END = "WARC/1.1", "\r\n", "\r\n\r\n"
INFO = "WARC-Warcinfo-ID: "


def base32_of_hex(hexed: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hex: each five hex digits are four of base 32."""
    fours = [F.lpad(F.lower(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32)), 4, "0") for i in range(8)]
    return F.translate(F.concat(*fours), "0123456789abcdefghijklmnopqrstuv", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of bytes, as WARC digests are written."""
    return base32_of_hex(F.sha1(data))


def _ascii_uri(uri: Column) -> Column:
    """Every byte outside printable ASCII percent-encoded; other URIs as they are."""
    each = F.transform(F.split(uri, ""), lambda c: F.when(c.rlike(r"[^\x21-\x7E]"), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c))
    return F.when(uri.rlike(r"[^\x21-\x7E]"), F.array_join(each, "")).otherwise(uri)


def records(df: DataFrame, id: str, payload: str, uri: str | None = None, least: int = 0) -> DataFrame:
    """(id, uri, payload binary, n_bytes, digest, type, refers_to): of equal payloads the one with the largest id is a
    response and the others revisit it; payloads under least bytes are all responses. A null payload is empty.

    A null id is the least. Rows that share the largest id are all responses. Only the digests that occur more than
    once are joined back, by a broadcast while they are few, so that payloads are not shuffled then.
    """
    at = df.select(F.col(id).alias("id"), (F.col(uri) if uri else F.lit(None).cast("string")).alias("uri"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    at = at.withColumns({"n_bytes": F.octet_length("payload").cast("long"), "digest": base32_sha1(F.col("payload"))})
    several = at.filter(F.col("n_bytes") >= least).groupBy("digest", "n_bytes").agg(F.max("id").alias("first"), F.count("*").alias("_n")).filter("_n > 1 and first is not null").drop("_n")
    at = at.join(small(store(several, "repeated-payloads")), ["digest", "n_bytes"], "left")
    at = at.withColumn("revisit", F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") < F.col("first"))))
    return at.select("id", "uri", "payload", "n_bytes", "digest", F.when(F.col("revisit"), "revisit").otherwise("response").alias("type"), F.when(F.col("revisit"), F.col("first")).alias("refers_to"))


def write_archives(recs: DataFrame, path: str, segment: int = SEGMENT, compression: str = "gzip") -> None:
    """records() as WARC files under path, one per task. A gzip file is read by one task; "none" lets tasks share a file.

    Records are named by a number of their own, given in the task that writes all their segments, and not by the id,
    which may be null or repeated. A revisit tells the id of its response (X-Refers-To-Id), as that has no known name yet.
    """
    archive = f"urn:uuid:{uuid.uuid4()}"
    revisit = F.col("type") == "revisit"
    at = recs.withColumns({"record": F.monotonically_increasing_id(), "segments": F.when(revisit, 1).otherwise(F.greatest(F.ceil(F.col("n_bytes") / segment), F.lit(1))).cast("int")})
    at = at.select("*", F.explode(F.sequence(F.lit(0), F.col("segments") - 1)).alias("n"))
    at = at.withColumn("block", F.when(revisit, F.lit(b"")).otherwise(F.substring("payload", F.col("n") * segment + 1, F.lit(segment))))
    name = lambda *more: F.concat(F.lit(f"<{archive}:"), F.concat_ws(":", F.col("record").cast("string"), *more), F.lit(">"))
    one = F.col("segments") == 1
    headers = [
        ("WARC-Type", F.when(F.col("n") == 0, F.col("type")).otherwise("continuation")),
        ("WARC-Record-ID", F.when(F.col("n") == 0, name()).otherwise(name((F.col("n") + 1).cast("string")))),
        ("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        ("WARC-Target-URI", _ascii_uri(F.col("uri"))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        ("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        ("WARC-Segment-Number", F.when(~one, F.col("n") + 1)),
        ("WARC-Segment-Origin-ID", F.when(~one & (F.col("n") > 0), name())),
        ("WARC-Segment-Total-Length", F.when(~one & (F.col("n") + 1 == F.col("segments")), F.col("n_bytes"))),
        ("X-Id", F.url_encode(F.col("id").cast("string"))),
        ("X-Refers-To-Id", F.url_encode(F.col("refers_to").cast("string"))),
        ("X-Full-Payload-Length", F.col("n_bytes")),
        ("Content-Length", F.octet_length("block")),
    ]
    first = f"{VERSION}{LINE}{INFO}<{archive}>"
    lines = F.concat_ws(LINE, F.lit(first), *(F.concat(F.lit(f"{k}: "), v.cast("string")) for k, v in headers))
    text = at.select(F.concat(F.encode(lines, "UTF-8"), F.lit(END.encode()), "block").cast("string").alias("value"))
    about = f"format: WARC File Format 1.1{LINE}"
    info = f"{first}{LINE}WARC-Type: warcinfo{LINE}WARC-Record-ID: <{archive}>{LINE}WARC-Date: 1970-01-01T00:00:00Z{LINE}Content-Type: application/warc-fields{LINE}Content-Length: {len(about)}{END}{about}"
    own = recs.sparkSession.range(1, numPartitions=1).select(F.lit(info).alias("value"))
    own.union(text).write.option("lineSep", END).option("compression", compression).text(path)


def _boundary(spark: SparkSession, path: str) -> str:
    """What stands between a block and the next record's headers; archives of other writers have no first header of their own."""
    head = [r[0] for r in spark.read.option("lineSep", LINE).text(path).take(2)]
    return f"{END}{VERSION}{LINE}" + (f"{head[1]}{LINE}" if len(head) == 2 and head[1].startswith(INFO) else "")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunked record table: (record, chunk, id string, type, block binary, block_bytes, whole, payload_bytes, payload_digest, refers_to string).

    One row per record or segment; chunk counts from 0; whole: the payload is in this row. The row is no larger than
    what the archive's writer put into a segment. A block shorter than its Content-Length fails as a damaged archive.
    """
    raw = spark.read.option("lineSep", _boundary(spark, path)).text(path)
    lines = F.substring_index("value", END, 1)
    head = F.concat(F.lit(LINE), lines, F.lit(LINE))
    field = lambda name: F.when(F.instr(F.col("head"), f"{LINE}{name}: ") > 0, F.substring_index(F.substring_index(F.col("head"), f"{LINE}{name}: ", -1), LINE, 1))
    # where the block starts is counted in bytes; string functions count characters
    at = raw.filter(F.instr("value", END) > 0).select(head.alias("head"), F.col("value").cast("binary").alias("value"), (F.octet_length(lines) + len(END) + 1).alias("start"))
    at = at.select("head", "value", "start", field("Content-Length").cast("int").alias("block_bytes"), field("WARC-Segment-Number").cast("int").alias("segment"), field("WARC-Type").alias("type")).filter("type <> 'warcinfo'")
    block = F.substring(F.col("value"), F.col("start"), F.col("block_bytes"))
    at = at.withColumn("block", F.when(F.octet_length(block) == F.col("block_bytes"), block).otherwise(F.raise_error(F.lit("a WARC block is shorter than its Content-Length"))))
    return at.select(
        F.regexp_extract(field("WARC-Record-ID"), r"^<urn:uuid:[^:]*:(\d+)", 1).try_cast("long").alias("record"),
        (F.coalesce("segment", F.lit(1)) - 1).alias("chunk"),
        F.url_decode(field("X-Id")).alias("id"),
        "type",
        "block",
        "block_bytes",
        F.col("segment").isNull().alias("whole"),
        field("X-Full-Payload-Length").cast("long").alias("payload_bytes"),
        F.substring_index(field("WARC-Payload-Digest"), ":", -1).alias("payload_digest"),
        F.url_decode(field("X-Refers-To-Id")).alias("refers_to"),
    )


def carried_digests(chunks: DataFrame) -> DataFrame:
    """(record, chunk, id, bytes_so_far, digest_so_far, type) of segmented records, SHA-1 carried over each record's chunks in order.

    Chunks are dealt by record and sorted, then read one by one: beside the batch being read, whose bytes
    spark.sql.execution.arrow.maxBytesPerBatch bounds, a task holds one running digest.
    """

    def carry(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        record, running, n, kind = None, hashlib.sha1(), 0, None
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                if r.chunk == 0 or record != r.record:
                    record, running, n, kind = r.record, hashlib.sha1(), 0, r.type
                running.update(r.block)
                n += len(r.block)
                out.append((record, r.chunk, r.id, n, running.hexdigest(), kind))
            yield pd.DataFrame(out, columns=["record", "chunk", "id", "bytes_so_far", "digest_so_far", "type"])

    parted = chunks.filter(~F.col("whole")).select("record", "chunk", "id", "type", "block").repartition("record").sortWithinPartitions("record", "chunk")
    return parted.mapInPandas(carry, "record long, chunk int, id string, bytes_so_far long, digest_so_far string, type string")


def read_records(chunks: DataFrame) -> DataFrame:
    """(record, id, payload_bytes, payload_digest, type, refers_to) as read back; digests of responses are of the bytes read."""
    sent = F.col("type") == "revisit"
    short = chunks.filter("whole").select(
        "record", "id", F.when(sent, F.col("payload_bytes")).otherwise(F.octet_length("block").cast("long")).alias("payload_bytes"),
        F.when(sent, F.col("payload_digest")).otherwise(base32_sha1(F.col("block"))).alias("payload_digest"), "type", "refers_to",
    )
    last = carried_digests(chunks).groupBy("record").agg(F.max("id").alias("id"), F.max("bytes_so_far").alias("payload_bytes"), F.max_by("digest_so_far", "chunk").alias("digest_so_far"), F.min_by("type", "chunk").alias("type"))
    return short.union(last.select("record", "id", "payload_bytes", base32_of_hex(F.col("digest_so_far")), "type", F.lit(None).cast("string")))


def round_trip(df: DataFrame, id: str = "page_id", payload: str = "html", uri: str | None = "url", segment: int = SEGMENT, compression: str = "gzip", least: int = 0) -> DataFrame:
    """Write a record per row of df to archives in the shared folder, read them back: (id, payload_bytes, payload_digest, record_type, refers_to).

    A null payload is empty. Null ids are written without one, come back null, and revisit any equal payload that has an
    id. Repeated rows each have a record of their own, of one segment or many; those that share the largest id of equal
    payloads are all responses. An empty table gives an empty result; other columns are ignored.
    """
    path, kind = new_path(df.sparkSession, "warc"), df.schema[id].dataType
    write_archives(records(df, id, payload, uri, least), path, segment, compression)
    back = read_records(read_chunks(df.sparkSession, path))
    return back.select(F.col("id").cast(kind).alias(id), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_to").cast(kind).alias("refers_to"))
