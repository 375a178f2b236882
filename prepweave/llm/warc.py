"""WARC archives: segmented, chunked records written by Spark, and their reassembly."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prepweave.llm.common import once, small, written

CRLF = "\r\n"
#: Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = "record_id string, type string, origin_id string, segment int, total_length long, refers_to string, payload_digest string, page_id long, block binary"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Rows of digests, of some 60 bytes each, that are broadcast at most.
SHARED = 500_000


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of a binary column in base32, upper case, without a prefix: five bits a character."""
    group = lambda digest, i: F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("long")
    char = lambda value, k: F.substring(F.lit(BASE32), (F.shiftright(value, 15 - 5 * k).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1))
    # each five hexadecimal digits are four characters
    spell = lambda digest: F.array_join(F.transform(F.array(*[group(digest, i) for i in range(8)]), lambda v: F.concat(*[char(v, k) for k in range(4)])), "")
    return once(F.sha1(payload), spell)


def _bytes(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def _joined(parts: Column) -> Column:
    """An array of binaries as one; Spark's strings are bytes, and neither the casts nor the join look at them."""
    return F.array_join(F.transform(parts, lambda x: x.cast("string")), "").cast("binary")


def _record_id(page_id: Column, segment: Column) -> Column:
    """A UUID URN from a hash: the same page and payload give the same record."""
    h = F.sha2(F.concat_ws(":", F.lit("record"), F.coalesce(page_id.cast("string"), F.lit("-")), "payload_digest", segment.cast("string")), 256)
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.substring(h, 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def label(pages: DataFrame, html: str = "html", least_bytes: int = 0) -> DataFrame:
    """The pages with payload, payload_digest and response_id.

    Of pages with equal payloads of at least least_bytes bytes, that with the largest page_id is the response of all;
    smaller payloads are each their own. The payload is the html in UTF-8, empty for null. The largest id is found over a
    written table of ids and digests. Digests that several pages have meet the pages by broadcast while they are at most
    SHARED rows; beyond that the join shuffles payloads by digest.
    """
    payload = _bytes(F.coalesce(F.col(html), F.lit("")))
    digests = written(pages.select("page_id", base32_sha1(payload).alias("__digest"), F.length(payload).alias("__size")), "digests")
    equal = digests.filter(F.col("__size") >= least_bytes).groupBy("__digest").agg(F.max("page_id").alias("__last"), F.count("*").alias("__n"))
    shared = small(written(equal.filter("__n > 1").select("__digest", "__last"), "shared"), SHARED)
    df = pages.withColumn("payload", payload).withColumn("payload_digest", base32_sha1(payload))
    joined = df.join(shared, (F.col("payload_digest") == F.col("__digest")) & (F.length("payload") >= least_bytes), "left")
    return joined.withColumn("response_id", F.coalesce("__last", "page_id")).drop("__digest", "__last")


def records(labelled: DataFrame, url: str = "url", chunk_bytes: int = 8192, segment_bytes: int = 65536) -> DataFrame:
    """One row per WARC record, column value: header and block, without the two line ends that close it.

    A response's payload stands in chunked transfer framing behind an HTTP head; the block is cut into segments of
    segment_bytes, the first in the response record, the others in continuation records that name it. A revisit has
    the HTTP head only.
    """
    chunk = F.lit(chunk_bytes)
    size = F.length("payload")
    n_chunks = F.ceil(size / chunk).cast("int")
    frame = lambda i: F.concat(_bytes(F.concat(F.lower(F.hex(F.least(chunk, size - i * chunk).cast("long"))), F.lit(CRLF))), F.substring("payload", (i * chunk + 1).cast("int"), chunk), _bytes(F.lit(CRLF)))
    frames = F.when(n_chunks > 0, _joined(F.transform(F.sequence(F.lit(0), F.greatest(n_chunks, F.lit(1)) - 1), frame))).otherwise(_bytes(F.lit("")))
    head = _bytes(F.lit(CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "Transfer-Encoding: chunked", "", ""])))
    revisit = ~F.col("page_id").eqNullSafe(F.col("response_id"))
    df = labelled.withColumn("__block", F.when(revisit, head).otherwise(F.concat(head, frames, _bytes(F.lit("0" + CRLF + CRLF))))).drop("payload")
    total = F.length("__block")
    df = df.withColumn("__n", F.greatest(F.ceil(total / F.lit(segment_bytes)).cast("int"), F.lit(1)))
    df = df.withColumn("__segment", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    s, many = F.col("__segment"), F.col("__n") > 1
    part = F.substring("__block", ((s - 1) * segment_bytes + 1).cast("int"), F.lit(segment_bytes))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    first = s == 1
    head_lines = F.concat_ws(
        CRLF,
        F.lit(VERSION),
        line("WARC-Type", F.when(~first, "continuation").when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("page_id"), s)),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        # a header's value is one line
        F.when(F.col(url).isNotNull(), line("WARC-Target-URI", F.regexp_replace(F.col(url), r"[\r\n]+", "%0A"))),
        line("X-Page-ID", F.col("page_id").cast("string")),
        F.when(first, line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest"))),
        F.when(revisit, line("WARC-Refers-To", _record_id(F.col("response_id"), F.lit(1)))),
        F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.when(many, line("WARC-Segment-Number", s.cast("string"))),
        F.when(~first, line("WARC-Segment-Origin-ID", _record_id(F.col("page_id"), F.lit(1)))),
        F.when(many & (s == F.col("__n")), line("WARC-Segment-Total-Length", total.cast("string"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        line("Content-Length", F.length(part).cast("string")),
        F.lit(CRLF),
    )
    return df.select(F.concat(_bytes(head_lines), part).cast("string").alias("value"))


def write_archives(rows: DataFrame, path: str, records_per_file: int = 16_384) -> None:
    """Writes record rows as gzipped WARC files by Spark's own committer, to any store that Spark writes to.

    Record size (segment_bytes and a header) and records_per_file bound a file's size: 1 GB before compression by the
    defaults, and about 64 MB of usual pages. Each row is closed by the record's two line ends.
    """
    rows.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def _inflated(data: bytes, most: int = 1 << 20) -> Iterator[bytes]:
    """An archive's bytes in pieces of at most `most`; it may be gzipped as a whole or record by record. What follows the
    last member is left out."""
    if data[:2] != b"\x1f\x8b":
        for i in range(0, len(data), most):
            yield data[i : i + most]
        return
    member, at = zlib.decompressobj(31), 0
    while at < len(data):
        feed, at = data[at : at + most], at + most
        while feed:
            if out := member.decompress(feed, most):
                yield out
            feed = member.unconsumed_tail
            if member.eof:
                feed, member = member.unused_data, zlib.decompressobj(31)
                if feed and feed[0] != 0x1F:
                    return


def _parse(data: bytes) -> Iterator[tuple]:
    """The records of an archive, one after another; besides its compressed bytes a record and a piece are held."""
    pieces, held = _inflated(data), bytearray()

    def more() -> bool:
        piece = next(pieces, None)
        held.extend(piece or b"")
        return piece is not None

    while True:
        while (at := held.find(VERSION.encode())) < 0:
            del held[: max(0, len(held) - len(VERSION))]
            if not more():
                return
        del held[:at]
        looked = 0
        while (end := held.find(b"\r\n\r\n", looked)) < 0:
            looked = max(0, len(held) - 3)
            if not more():
                raise ValueError("a record's header does not end")
        head = {}
        for row in bytes(held[:end]).split(b"\r\n")[1:]:
            name, _, value = row.partition(b":")
            head[name.strip().lower().decode()] = value.strip().decode()
        length = int(head["content-length"])
        while len(held) < end + 4 + length:
            if not more():
                raise ValueError("a record is shorter than its Content-Length")
        block = bytes(held[end + 4 : end + 4 + length])
        del held[: end + 4 + length]
        kind, own = head["warc-type"], head["warc-record-id"]
        digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
        total = head.get("warc-segment-total-length")
        page = head.get("x-page-id")
        segment = int(head.get("warc-segment-number", 0))
        yield own, kind, head.get("warc-segment-origin-id", own), segment, int(total) if total else None, head.get("warc-refers-to"), digest, int(page) if page else None, block


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below a path: a row each, with RECORD_SCHEMA's columns. An archive is one row of
    Spark's binaryFile source, so archives should be of bounded size, as write_archives makes them."""

    def parse(frames):
        names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
        for frame in frames:
            for content in frame["content"]:
                found = _parse(content)
                while some := list(islice(found, 256)):
                    yield pd.DataFrame(some, columns=names).astype({"segment": "Int32", "total_length": "Int64", "page_id": "Int64"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInPandas(parse, RECORD_SCHEMA)


def reassemble(read: DataFrame) -> DataFrame:
    """Whole records: the segments of an origin joined in order of their numbers, with column problem.

    Records without a segment number stand for themselves and are not shuffled. problem is null, or says that segments
    are missing or repeated, or that the length differs from WARC-Segment-Total-Length; such a record keeps what is there.
    An origin whose every segment stands k times is k equal records.
    """
    whole = read.filter("segment = 0").select("record_id", "type", "refers_to", "payload_digest", "page_id", "block", F.lit(None).cast("string").alias("problem"))
    parts = read.filter("segment > 0").groupBy("origin_id").agg(
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("segments"),
        F.max("total_length").alias("total"),
        *[F.max_by(c, F.when(F.col("segment") == 1, 1).otherwise(0)).alias(c) for c in ("type", "refers_to", "payload_digest", "page_id")],
    )
    copies = F.floor(F.size("segments") / F.element_at("segments", -1)["segment"]).cast("int")
    parts = parts.withColumn("copies", F.greatest(copies, F.lit(1)))
    numbers = F.col("segments.segment")
    expected = F.transform(F.sequence(F.lit(0), F.size("segments") - 1), lambda i: (F.floor(i / F.col("copies")) + 1).cast("int"))
    parts = parts.withColumn("odd", numbers != expected).withColumn("segments", F.filter("segments", lambda x, i: i % F.col("copies") == 0))
    block = _joined(F.col("segments.block"))
    problem = F.when(F.col("odd"), "segments are missing or repeated").when(F.col("total").isNull() | (F.length("block") != F.col("total")), "the length differs from the total")
    joined = parts.withColumn("block", block).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return whole.unionByName(joined.select(F.col("origin_id").alias("record_id"), "type", "refers_to", "payload_digest", "page_id", "block", problem.alias("problem")))


def dechunk(body: bytes) -> bytes:
    """The payload of a body in chunked transfer framing; chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        chunk = body[end + 2 : end + 2 + size]
        if len(chunk) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is shorter than its size")
        out.append(chunk)
        at = end + 4 + size


def decode(blocks: DataFrame) -> DataFrame:
    """Adds payload_bytes and actual_digest to reassembled records: of a response's payload behind its HTTP head, with
    chunked framing decoded. For a revisit both are null. A framing error is named in column problem."""

    @F.pandas_udf("struct<payload_bytes: long, actual_digest: string, fault: string>")
    def payload(kinds: pd.Series, blocks: pd.Series) -> pd.DataFrame:
        out = []
        for kind, block in zip(kinds, blocks):
            if kind == "revisit" or block is None:
                out.append((None, None, None))
                continue
            head, _, body = bytes(block).partition(b"\r\n\r\n")
            try:
                if b"transfer-encoding: chunked" in head.lower():
                    body = dechunk(body)
                out.append((len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), None))
            except ValueError as e:
                out.append((None, None, f"framing: {e}"))
        return pd.DataFrame(out, columns=["payload_bytes", "actual_digest", "fault"]).astype({"payload_bytes": "Int64"})

    df = blocks.withColumn("__p", payload("type", "block"))
    return df.select("record_id", "type", "refers_to", "payload_digest", "page_id", F.coalesce("problem", "__p.fault").alias("problem"), F.col("__p.payload_bytes").alias("payload_bytes"), F.col("__p.actual_digest").alias("actual_digest"))


def pages_of(decoded: DataFrame) -> DataFrame:
    """Per page its payload's size and digest, record type and the page that a revisit refers to, read from the records.

    A response whose payload does not have the digest of its header, or whose record has a problem, is an error.
    """
    wrong = F.col("problem").isNotNull() | ((F.col("type") == "response") & ~F.col("payload_digest").eqNullSafe(F.col("actual_digest")))
    ok = decoded.withColumn("payload_digest", F.when(wrong, F.raise_error(F.concat_ws(" ", F.lit("bad record"), "record_id", "problem"))).otherwise(F.col("payload_digest")))
    ok = written(ok.select("record_id", "type", "refers_to", "payload_digest", "page_id", "payload_bytes"), "records")
    named = ok.filter("type = 'revisit'").select("refers_to").distinct()
    origins = ok.filter("type = 'response'").join(named.withColumnRenamed("refers_to", "__r"), F.col("record_id") == F.col("__r"), "left_semi").select(F.col("record_id").alias("__id"), F.col("page_id").alias("__page"), F.col("payload_bytes").alias("__bytes")).dropDuplicates(["__id"])
    # few responses that many revisits name go to each task, so that the revisits of one payload do not meet in one
    joined = ok.join(small(written(origins, "origins"), SHARED), F.col("refers_to") == F.col("__id"), "left")
    return joined.select("page_id", F.coalesce("payload_bytes", "__bytes").alias("payload_bytes"), "payload_digest", F.col("type").alias("record_type"), F.when(F.col("type") == "revisit", F.col("__page")).alias("refers_to"))


def round_trip(pages: DataFrame, path: str, html: str = "html", url: str = "url", **settings) -> DataFrame:
    """Writes the pages as WARC archives below path and reads them back; see label() and pages_of().

    Null html has an empty payload, a null url gives no target line, an empty table gives an empty result, and other
    columns are not read. A row that repeats another gives a record of its own with the same id; where a payload's largest
    page_id stands in several rows, each of them is a response.
    """
    least = settings.pop("least_bytes", 0)
    write_archives(records(label(pages.select("page_id", F.col(url).alias("url"), F.col(html).alias("html")), "html", least), "url", **settings), path)
    return pages_of(decode(reassemble(read_records(pages.sparkSession, path))))
