"""WARC archives of pages: segmented records written by Spark, read back and put together.

Writing.  A page is an HTTP response in chunked transfer framing.  Its block is cut into segments
of bounded size: a ``response`` record with segment number 1 and ``continuation`` records that
name its id, the last with the total length.  Of pages with equal payloads of at least
``least_shared`` bytes the one with the smallest id is stored, the others become ``revisit``
records without a body.  Records are byte strings that the text writer lays down as they are, so
archives go wherever Spark writes, with its commit protocol, and a lost task is written again.

Reading.  Each archive is parsed by its Content-Length fields.  Records of one segment are
decoded at once.  Only records of several segments are shuffled: grouped by origin id, ordered
by segment number, checked against numbering and total length, then freed of their framing.  A
group holds one page and no more.  A payload must match its recorded digest.

Only ids and digests are shuffled to find equal payloads, pre-aggregated; a payload that a third of
all pages share is one row by then.  Pages then meet the (page, original) pairs by page.

Cases: a null html is an empty payload; null urls and ids are written as empty fields.  Pages
with the same smallest id and payload are all responses.  Pages of null id share a payload only by
pointing to one with an id.  An empty table gives no archive and no rows.  Very long pages are many
segments.  Extra columns are ignored.  A broken archive raises an error that names the record.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bugsieve.functions.text import let
from bugsieve.llm.common import text_batches

LEAST_SHARED = 100
SEGMENT = 32 << 10  # bytes of a block in one record
CHUNK = 8 << 10  # bytes of payload in one transfer chunk
RECORDS_PER_FILE = 1000  # so an archive is at most some 32 MB before compression

_END = "\r\n"
_RESPONSE_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def _bytes(text: Column) -> Column:
    return text.cast("binary")


def _raw(data: Column) -> Column:
    """Bytes as a string column: Spark keeps them as they are."""
    return data.cast("string")


def _pieces(data: Column, size: int) -> Column:
    """Consecutive pieces of at most ``size`` bytes; of no bytes, one empty piece."""
    n = F.octet_length(data)
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size))
    return F.transform(starts, lambda s: F.substring(data, s + 1, F.lit(size)))


def _chunked(payload: Column, size: int) -> Column:
    """Bytes in chunked transfer framing."""
    framed = F.transform(
        _pieces(payload, size),
        lambda p: F.when(
            F.octet_length(p) > 0, F.concat(F.lower(F.hex(F.octet_length(p))), F.lit(_END), _raw(p), F.lit(_END))
        ).otherwise(F.lit("")),
    )
    return _bytes(F.concat(F.array_join(framed, ""), F.lit("0\r\n\r\n")))


def originals(pages: DataFrame, least_shared: int = LEAST_SHARED) -> DataFrame:
    """``(page_id, refers_to)``: for each page that repeats a payload, the page that stores it."""
    marked = pages.select(
        "page_id", F.octet_length("payload").alias("n"), F.sha2("payload", 256).alias("digest")
    ).filter(F.col("n") >= least_shared)
    shared = (
        marked.groupBy("digest")
        .agg(F.min("page_id").alias("refers_to"), F.count("*").alias("times"))
        .filter("times > 1 AND refers_to IS NOT NULL")
        .select("digest", "refers_to")
    )
    return marked.join(shared, "digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select(
        "page_id", "digest", "refers_to"
    ).distinct()


def write(
    pages: DataFrame,
    path: str,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    least_shared: int = LEAST_SHARED,
    segment: int = SEGMENT,
    chunk: int = CHUNK,
) -> None:
    """Write one WARC record, or several segments, per page to gzipped archives under ``path``."""
    own = pages.select(
        F.col(f"`{page_id}`").cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce(F.col(f"`{url}`"), F.lit("")), r"[\r\n]", " ").alias("url"),
        _bytes(F.coalesce(F.col(f"`{html}`"), F.lit(""))).alias("payload"),
    )
    repeats = originals(own, least_shared).select(
        F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "refers_to"
    )
    digested = own.withColumn("digest", F.sha2("payload", 256))
    same = F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    known = digested.join(repeats, same, "left").withColumn("row", F.monotonically_increasing_id())
    stored = F.col("refers_to").isNull()
    length = F.octet_length("payload")
    head = F.lit(_RESPONSE_HEAD)
    block = F.when(
        stored,
        F.concat(
            _bytes(F.concat(head, F.lit("Transfer-Encoding: chunked\r\n\r\n"))), _chunked(F.col("payload"), chunk)
        ),
    ).otherwise(_bytes(F.concat(head, F.lit("Content-Length: "), length.cast("string"), F.lit("\r\n\r\n"))))
    name = lambda row: F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(":"), row, F.lit(">"))

    def cut_up(b: Column) -> Column:
        return F.transform(
            _pieces(b, segment), lambda p: F.struct(p.alias("piece"), F.octet_length(b).alias("total"))
        )

    cut = known.select(
        "page_id", "url", "digest", "refers_to", "row", F.posexplode(let(block, cut_up)).alias("k", "x")
    ).select("page_id", "url", "digest", "refers_to", "row", "k", "x.piece", "x.total")
    several = F.col("total") > segment
    row = F.col("row").cast("string")
    first, last = F.col("k") == 0, (F.col("k") + 1) * segment >= F.col("total")
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit(_END))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(~first, "continuation").when(F.col("refers_to").isNull(), "response").otherwise("revisit")),
        line("WARC-Record-ID", name(F.when(first, row).otherwise(F.concat(row, F.lit("-"), F.col("k").cast("string"))))),
        line("WARC-Date", F.lit("2020-01-01T00:00:00Z")),
        line("WARC-Target-URI", F.col("url")),
        F.when(first, line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))).otherwise(""),
        F.when(first & F.col("refers_to").isNotNull(), F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        )).otherwise(""),
        F.when(several, line("WARC-Segment-Number", (F.col("k") + 1).cast("string"))).otherwise(""),
        F.when(several & ~first, line("WARC-Segment-Origin-ID", name(row))).otherwise(""),
        F.when(several & last, line("WARC-Segment-Total-Length", F.col("total").cast("string"))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("piece").cast("string")),
        F.lit(_END),
        _raw(F.col("piece")),
    )
    cut.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option(
        "maxRecordsPerFile", RECORDS_PER_FILE
    ).text(path)


_PARSED = (
    "record_id string, page_id long, record_type string, refers_to long, digest string, segment int, "
    "total long, block binary"
)
_PAGE_OF = re.compile(r"<urn:page:(-?[0-9]*)(?::([0-9]*)(?:-[0-9]+)?)?>")


def _records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive."""
    at, n = 0, len(data)
    while at < n:
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode("utf-8", "surrogateescape").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record starts at byte {at}")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        start = stop + 4
        end = start + int(headers["content-length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record {headers.get('warc-record-id')} does not end where it says")
        yield headers, data[start:end]
        at = end + 4


def _number(found: str | None) -> int | None:
    return int(found) if found else None


def records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under ``path``, as they lie there."""
    text_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                for h, block in _records(zlib.decompress(content.as_buffer(), 31)):
                    origin = h.get("warc-segment-origin-id") or h["warc-record-id"]
                    digest = h.get("warc-payload-digest", "").removeprefix("sha256:") or None
                    refers = h.get("warc-refers-to")
                    rows.append(
                        (
                            origin,
                            _number(_PAGE_OF.fullmatch(origin)[1]),
                            h["warc-type"],
                            _number(_PAGE_OF.fullmatch(refers)[1]) if refers else None,
                            digest,
                            int(h.get("warc-segment-number", 0)),
                            _number(h.get("warc-segment-total-length")),
                            block,
                        )
                    )
                    if len(rows) == 128:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    return files.mapInArrow(run, _PARSED)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in _PARSED.split(", ")]
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; raises an error if the framing is broken."""
    parts, at = [], 0
    while True:
        stop = body.index(b"\r\n", at)
        size = int(body[at:stop].split(b";")[0], 16)
        start = stop + 2
        if size == 0:
            return b"".join(parts)
        if body[start + size : start + size + 2] != b"\r\n":
            raise ValueError(f"a chunk at byte {at} does not end where it says")
        parts.append(body[start : start + size])
        at = start + size + 2


def payload_of(block: bytes) -> tuple[bytes | None, int]:
    """Payload and its length; a block without a body has only the length it names."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(b": ") for x in head.split(b"\r\n")[1:])}
    if fields.get(b"transfer-encoding") == b"chunked":
        payload = unchunked(body)
        return payload, len(payload)
    size = int(fields[b"content-length"])
    if body and len(body) != size:
        raise ValueError("a body is not as long as it says")
    return (body if body or size == 0 else None), size


def read(spark: SparkSession, path: str) -> DataFrame:
    """``(page_id, record_type, refers_to, payload, payload_bytes, payload_digest)`` per page.

    The payload of a revisit is null; its length and digest are those of the full payload.
    """
    found = records(spark, path)
    single = found.filter("segment = 0").drop("segment", "total")
    parts = F.array_sort(F.collect_list(F.struct("segment", "total", "block")))
    n = F.size("parts")
    joined = _bytes(F.array_join(F.transform("parts", lambda p: _raw(p["block"])), ""))
    total = F.element_at("parts", -1)["total"]
    whole = (n == F.element_at("parts", -1)["segment"]) & (F.element_at("parts", 1)["segment"] == 1)
    several = (
        found.filter("segment > 0")
        .groupBy("record_id")
        .agg(
            F.max("page_id").alias("page_id"),
            F.max(F.when(F.col("segment") == 1, F.col("record_type"))).alias("record_type"),
            F.max("refers_to").alias("refers_to"),
            F.max("digest").alias("digest"),
            parts.alias("parts"),
        )
        .withColumn("block", joined)
        .withColumn(
            "block",
            F.when(whole & (F.octet_length("block") == total), F.col("block")).otherwise(
                F.raise_error(F.concat(F.lit("segments are missing of "), F.col("record_id"))).cast("binary")
            ),
        )
        .select("record_id", "page_id", "record_type", "refers_to", "digest", "block")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads, sizes, digests = [], [], []
            for block, digest, record in zip(batch.column("block"), batch.column("digest"), batch.column("record_id")):
                payload, size = payload_of(block.as_py())
                if payload is not None and hashlib.sha256(payload).hexdigest() != digest.as_py():
                    raise ValueError(f"the payload of {record.as_py()} is not what its digest says")
                payloads.append(payload)
                sizes.append(size)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("record_type"),
                    batch.column("refers_to"),
                    pa.array(payloads, pa.binary()),
                    pa.array(sizes, pa.int64()),
                    batch.column("digest"),
                ],
                names=["page_id", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest"],
            )

    return single.unionByName(several).mapInArrow(
        run,
        "page_id long, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string",
    )
