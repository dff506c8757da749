"""WARC archives: writing pages in segments, and reading and reassembling them.

Writing: a page is one record of an HTTP response in chunked transfer framing. A block
over the segment size is cut: the first piece stays a response with segment number 1, the
rest are continuation records that name the first one's identifier as their origin, the
last with the total length. Records go through Spark's text writer, whose line end is the
last byte of a record, into gzipped files of a bounded number of records. The writer makes
one gzip stream a file and names it .txt.gz; reading takes files of a member a record too.

Reading: files are parsed record by record. Unsegmented records need no shuffle. Pieces
are grouped by origin identifier, ordered by segment number, checked for gaps and for the
total length, joined, and their chunked framing is decoded.
"""

from __future__ import annotations

import base64
import gzip
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafstrata.llm.common import materialise, numbered, pick, repeated, scratch, small, table

VERSION = b"WARC/1.1"
#: Bytes of a record's block beyond which it is cut into segments.
SEGMENT_BYTES = 32 << 10
#: Bytes of a chunk of the transfer framing.
CHUNK_BYTES = 8 << 10
#: Records a file holds at most: with the segment size this bounds what one read task loads.
FILE_RECORDS = 512
#: Payloads of fewer bytes are never revisits.
REVISIT_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
REVISIT_HEAD = b"HTTP/1.1 304 Not Modified\r\n\r\n"


def record_id(key: str, label: str, segment: int = 1) -> str:
    """A stable identifier of the record of a page with a payload of that digest, or of one of its continuations."""
    h = hashlib.md5(f"{key}/{label}/{segment}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def sha1_label(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """``payload`` in chunked transfer framing."""
    parts = []
    for i in range(0, len(payload), size):
        piece = payload[i : i + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunk(body: bytes) -> bytes:
    """The payload of a body in chunked framing; chunk extensions and trailers are skipped."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";", 1)[0].strip(), 16)
        at = end + 2
        if not size:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk doesn't end where its size says")
        parts.append(body[at : at + size])
        at += size + 2


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [f"{k}: {v}".encode() for k, v in [*headers, ("Content-Length", str(len(block)))]]
    return b"\r\n".join([VERSION, *lines, b"", block, b"", b""])


def records(key: str, url: str, payload: bytes, refers_to: str | None, segment: int = SEGMENT_BYTES) -> list[bytes]:
    """The records of a page: a revisit, a response, or a response and its continuations.

    ``key`` makes the identifiers; ``refers_to`` is the key of the page that is revisited.
    """
    url = "".join(c for c in url if c not in "\r\n")
    label = sha1_label(payload)
    base = [("WARC-Target-URI", url), ("WARC-Date", DATE), ("X-Page-Key", key), ("WARC-Payload-Digest", label), ("Content-Type", "application/http;msgtype=response")]
    name = record_id(key, label)
    if refers_to is not None:
        more = [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, label))]
        return [_record([("WARC-Type", "revisit"), ("WARC-Record-ID", name), *more, *base], REVISIT_HEAD)]
    block = HEAD + chunked(payload)
    if len(block) <= segment:
        return [_record([("WARC-Type", "response"), ("WARC-Record-ID", name), *base], block)]
    out = [_record([("WARC-Type", "response"), ("WARC-Record-ID", name), ("WARC-Segment-Number", "1"), *base], block[:segment])]
    count = -(-len(block) // segment)
    for n in range(2, count + 1):
        headers = [("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(key, label, n)), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(n)), *base[:3]]
        if n == count:
            headers.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(_record(headers, block[(n - 1) * segment : n * segment]))
    return out


def parse(content: bytes):
    """(headers, block) of each record of an archive; header names in lower case."""
    at = 0
    while at < len(content):
        if not content.startswith(b"WARC/1.", at):
            raise ValueError(f"no record begins at byte {at}")
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].split(b"\r\n")[1:]
        headers = {k.strip().decode().lower(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines)}
        start = end + 4
        stop = start + int(headers["content-length"])
        if content[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} doesn't end where its length says")
        yield headers, content[start:stop]
        at = stop + 4


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT_BYTES, file_records: int = FILE_RECORDS) -> None:
    """Write a record per row of ``pages``: key, url, payload (bytes) and refers_to (a key or null)."""
    rows = pick(pages, "key", "url", "payload", "refers_to")

    def run(batches):
        for b in batches:
            made = [x for key, url, payload, to in zip(*(c.to_pylist() for c in b.columns), strict=True) for x in records(key, url or "", payload or b"", to, segment)]
            yield pa.record_batch([pa.array([x[:-1] for x in made], pa.large_binary())], names=["record"])  # the line end is a record's last byte

    written = rows.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    written.write.option("lineSep", "\n").option("maxRecordsPerFile", file_records).option("compression", "gzip").text(path)


_PARSED = "record_id string, warc_type string, url string, key string, origin string, segment int, total long, refers_to string, digest string, block binary"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row a record, as parsed: see _PARSED. segment and origin are null for whole records."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches):
        fields = ("warc-record-id", "warc-type", "warc-target-uri", "x-page-key", "warc-segment-origin-id", "warc-segment-number", "warc-segment-total-length", "warc-refers-to", "warc-payload-digest")
        kinds = [pa.string()] * 5 + [pa.int32(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        names = [f.split()[0] for f in _PARSED.split(", ")]
        for b in batches:
            for content in b.column(0):
                rows = []
                for h, block in parse(gzip.decompress(content.as_py())):
                    got = [h.get(f) for f in fields]
                    rows.append([*got[:5], got[5] and int(got[5]), got[6] and int(got[6]), *got[7:], block])
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return files.mapInArrow(run, _PARSED)


def _decode(batches):
    for b in batches:
        ids, types, urls, keys, refers, digests, blocks, pieces, totals = (c.to_pylist() for c in b.columns)
        payloads, whole = [], []
        for block, n, total, kind, digest in zip(blocks, pieces, totals, types, digests, strict=True):
            payload, ok = b"", False
            if kind == "revisit":
                payload, ok = None, True
            elif block is not None and (n == 1 and total is None or total == len(block)):
                head, _, body = block.partition(b"\r\n\r\n")
                try:
                    payload = dechunk(body) if b"transfer-encoding: chunked" in head.lower() else body
                    ok = digest is None or sha1_label(payload) == digest
                except ValueError:
                    payload = b""
            payloads.append(payload)
            whole.append(ok)
        yield pa.record_batch(
            [*(pa.array(c, pa.string()) for c in (ids, types, urls, keys, refers, digests)), pa.array(payloads, pa.binary()), pa.array(whole, pa.bool_())],
            names=["record_id", "record_type", "url", "key", "refers_to", "digest", "payload", "complete"],
        )


def reassemble(parsed: DataFrame) -> DataFrame:
    """One row per page record: record_id, record_type, url, key, refers_to, digest, payload, complete.

    Revisits have a null payload. complete is false, and the payload empty, where a
    segment is missing or repeated with other bytes, the total length differs, the framing
    is broken or the digest doesn't hold; nothing is dropped. A continuation without its
    first segment gives such a row under the origin's identifier, with type response.
    """
    whole = parsed.where("segment IS NULL").selectExpr("record_id", "warc_type", "url", "key", "refers_to", "digest", "block", "1 AS pieces", "CAST(NULL AS BIGINT) AS total")
    cut = (
        parsed.where("segment IS NOT NULL")
        .withColumn("of", F.coalesce("origin", "record_id"))
        .groupBy("of")
        .agg(
            F.array_sort(F.collect_set(F.struct("segment", "block"))).alias("parts"),
            F.max("total").alias("total"),
            F.max("url").alias("url"),
            F.max("key").alias("key"),
            F.max(F.when(F.col("segment") == 1, F.col("digest"))).alias("digest"),
        )
    )
    gapless = "size(parts) = element_at(parts, -1).segment AND parts[0].segment = 1"
    joined = cut.selectExpr(
        "of AS record_id", "'response' AS warc_type", "url", "key", "CAST(NULL AS STRING) AS refers_to", "digest",
        f"CASE WHEN {gapless} THEN aggregate(parts, CAST('' AS BINARY), (a, p) -> concat(a, p.block)) END AS block",
        "size(parts) AS pieces", "coalesce(total, -1L) AS total",
    )
    fields = "record_id string, record_type string, url string, key string, refers_to string, digest string, payload binary, complete boolean"
    return whole.unionByName(joined).mapInArrow(_decode, fields)


def revisits(pages: DataFrame, min_bytes: int = REVISIT_BYTES) -> DataFrame:
    """``pages`` (page_id, url, payload) as key, url, payload, refers_to: a key for each row, and for revisits the key of the response.

    Of equal payloads of min_bytes or more the row with the largest page_id, then url, is the
    response; of equal rows the first. The key is the page_id, with a digest of the url and
    a number where rows repeat a page_id with one payload or have none.

    Payloads are equal by their SHA-256. Digests are shuffled; payloads only of rows that
    repeat, or where the revisits are too many to broadcast.
    """
    digest, bytes_ = F.sha2("payload", 256).alias("digest"), F.length("payload").alias("bytes")
    mark = F.xxhash64("digest", "page_id").alias("mark")
    narrow = materialise(pages.select(digest, bytes_, "page_id", "url").select("*", mark, F.struct("page_id", "url", "digest").alias("page")), "warc-digests")
    again = repeated(narrow, "mark")
    side = small(again)

    def keyed(rows: DataFrame, id_: str, url: str) -> DataFrame:
        """``rows`` with occurrence and key; pages of a repeated mark differ by url or occurrence."""
        own = F.concat_ws("/", F.coalesce(F.col(id_).cast("string"), F.lit("null")), F.substring(F.md5(F.coalesce(url, F.lit("")).cast("binary")), 1, 16), "occurrence")
        alone = F.col("_mark").isNull() & F.col(id_).isNotNull()
        of = numbered(rows, "mark", "page", again).join(side, F.col("mark") == side["_mark"], "left")
        return of.withColumn("key", F.when(alone, F.col(id_).cast("string")).otherwise(own)).drop("_mark")

    names = materialise(keyed(narrow, "page_id", "url"), "warc-keys")
    order = F.struct("page_id", "url", (-F.col("occurrence")).alias("o"), "key")
    last = names.where(F.col("bytes") >= min_bytes).groupBy(F.col("digest").alias("m")).agg(F.max(order).alias("last"), F.count("*").alias("n")).where("n > 1").select("m", F.col("last.key").alias("to"))
    found = names.select("key", "digest").join(last, F.col("digest") == F.col("m")).where("key <> to").select(F.col("key").alias("k"), "m", F.col("to").alias("refers_to"))
    found = small(materialise(found, "warc-revisits"))
    whole = pages.select(F.sha2("payload", 256).alias("digest"), F.struct("page_id", "url", "payload").alias("page"))
    whole = keyed(whole.withColumn("mark", F.xxhash64("digest", "page.page_id")), "page.page_id", "page.url")
    return whole.join(found, (F.col("key") == F.col("k")) & (F.col("digest") == F.col("m")), "left").select("key", "page.url", "page.payload", "refers_to")


def archive_pages(pages: DataFrame, path: str) -> None:
    """Write pages (page_id, url, html; null html is empty) as WARC archives with revisits.

    One record a row, also for rows that repeat or have no page_id (their keys begin with
    ``null``); see revisits(). Extra columns are ignored; an empty table writes no records.
    """
    bare = pick(pages, "page_id", "url", "html").select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    write_archives(revisits(bare), path)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    path = scratch(spark, "warc")
    archive_pages(pages, path)
    records_read = reassemble(read_archives(spark, path))
    page = F.split_part("key", F.lit("/"), F.lit(1)).try_cast("long")
    damaged = F.raise_error(F.concat(F.lit("a record is incomplete: "), "record_id"))
    own = materialise(
        records_read.select(
            F.when(F.col("complete"), F.col("record_id")).otherwise(damaged).alias("record_id"), page.alias("page_id"), "record_type", "refers_to",
            F.length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("sha1"),
        ),
        "warc-read",
    )
    wrote, read = pages.count(), own.count()
    if wrote != read:
        raise RuntimeError(f"{wrote} pages were written, {read} records read back")
    sources = own.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("to"), F.col("bytes").alias("b"), F.col("sha1").alias("s"))
    return own.join(sources, "refers_to", "left").select(
        "page_id", F.coalesce("bytes", "b").alias("payload_bytes"), F.coalesce("sha1", "s").alias("payload_digest"), "record_type", F.col("to").alias("refers_to")
    )


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last, row_number() OVER (PARTITION BY h ORDER BY page_id DESC NULLS LAST) AS n FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN strlen(h) >= 1000 AND n > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(h) >= 1000 AND n > 1 THEN last END AS refers_to
FROM g
"""
