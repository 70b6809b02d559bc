"""WARC archives with revisit records for repeated payloads.

Headers alone (id, digest and length of payload) are shuffled to be resolved: payload digests are grouped, and every
record of a repeated digest learns which record is its original. What they learn, a row for each revisit, then meets
the pages in one join, and fresh archives are written from its partitions, cut by bytes, each with a ``warcinfo`` record.
Archives are WARC 1.1 files, each one gzip stream (not a stream for each record, so they are read from their beginning);
Spark's text writer puts the blank lines that end an archive, so any file system that Spark writes to will do.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import materialize

#: Payloads below this many bytes are always written in full.
MIN_REVISIT_BYTES = 1000
#: Bytes of payload in one archive file, about. A file is read back whole.
FILE_BYTES = 16 << 20
#: Places over which the records of one digest are spread for the join with their original.
SALTS = 32

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(*name: Column) -> Column:
    """A URN from the page id, and for further copies of a page what tells them apart, so that a retried task writes the
    same."""
    h = F.md5(F.concat(F.lit("page "), F.concat_ws(" ", *(n.cast("string") for n in name))))
    part = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *part), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value; control characters are percent-encoded."""
    safe = F.regexp_replace(F.regexp_replace(value, "\r", "%0D"), "\n", "%0A")
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), safe, F.lit(CRLF))).otherwise("")


ADDED = ("payload_bytes", "payload_digest", "record_type", "refers_to", "copy")


def resolve_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES, id_col: str = "page_id") -> DataFrame:
    """Adds ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to`` and ``copy`` to ``pages(id, url, html)``.

    Columns of those names give way. Of records with equal payloads of at least ``min_bytes`` bytes the one with the largest
    id is the response; digest and length together decide equality. Of rows that repeat that id and payload one, with the
    first url, is the response and the others revisit it, their own id; ``copy`` numbers rows of the same id, url and
    payload from 0. A null id is a response and never an original.
    """
    pages = pages.drop(*ADDED)
    raw = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    marked = pages.withColumns({"payload_bytes": F.octet_length(F.coalesce("html", F.lit(""))).cast("long"), "payload_digest": F.sha1(raw)})
    payload = ["payload_digest", "payload_bytes"]
    headers = marked.filter(F.col(id_col).isNotNull() & (F.col("payload_bytes") >= min_bytes)).select(id_col, *payload, "url")
    originals = headers.groupBy(*payload).agg(F.max(id_col).alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    spread = originals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = headers.withColumn("salt", F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int"))
    known = salted.join(spread, [*payload, "salt"]).groupBy(id_col, *payload, "refers_to").agg(F.count("*").alias("n"), F.min("url").alias("first_url"))
    known = materialize(known.filter((F.col(id_col) != F.col("refers_to")) | (F.col("n") > 1)), "revisits")
    met = marked.join(known, [id_col, *payload], "left").withColumn("tied", F.coalesce(F.col(id_col) == F.col("refers_to"), F.lit(False)))
    names = [*marked.columns, "record_type", "refers_to", "copy"]
    kind = F.when(F.col("refers_to").isNotNull(), "revisit").otherwise("response")
    plain = met.filter("not tied").withColumns({"record_type": kind, "copy": F.lit(0).cast("long")}).select(*names)
    # rows that repeat the original are counted, not sorted: equal ones are one row until they are numbered
    rest = [c for c in marked.columns if c not in (id_col, *payload)]
    tied = met.filter("tied").groupBy(id_col, *payload, *rest, "refers_to", "first_url").agg(F.count("*").alias("rows"))
    tied = tied.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
    is_first = (F.col("copy") == 0) & F.col("url").eqNullSafe(F.col("first_url"))
    tied = tied.withColumns({"record_type": F.when(is_first, "response").otherwise("revisit"), "refers_to": F.when(~is_first, F.col("refers_to"))})
    return plain.unionByName(tied.select(*names))


def write_warc(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    date: str = "2024-01-01T00:00:00Z",
    min_bytes: int = MIN_REVISIT_BYTES,
) -> None:
    """Writes one record per row. A null payload is empty and a null url has no target line. No rows: no records."""
    source = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")
    )
    resolved = resolve_revisits(source, min_bytes)
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit(CRLF * 2),
    )
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, http).otherwise(F.concat(http, F.coalesce("html", F.lit(""))))
    page, copy = F.col("page_id"), F.col("copy")
    another = F.col("refers_to").eqNullSafe(page) & page.isNotNull()
    record_id = F.when(page.isNull(), "<urn:null>").when(another, _record_id(page, F.lit("copy"), copy, F.coalesce("url", F.lit("")))).otherwise(_record_id(page))
    record = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _field("WARC-Type", F.col("record_type")),
        _field("WARC-Record-ID", record_id),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", F.col("url")),
        _field("WARC-Page-ID", F.col("page_id").cast("string")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, _field("WARC-Profile", F.lit(PROFILE))).otherwise(""),
        _field("WARC-Refers-To", F.when(revisit, _record_id(F.col("refers_to")))),
        _field("Content-Type", F.lit("application/http; msgtype=response")),
        _field("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
        block,
    )
    info = f"WARC/1.1{CRLF}WARC-Type: warcinfo{CRLF}WARC-Date: {date}{CRLF}WARC-Record-ID: "
    fields = f"format: WARC File Format 1.1{CRLF}"

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Records of a task put together to archives of about ``FILE_BYTES``; a longer record stands alone."""
        held, size = [], 0

        def archive() -> pa.RecordBatch:
            name = hashlib.md5(held[0].encode()).hexdigest()
            urn = "-".join(name[a:b] for a, b in ((0, 8), (8, 12), (12, 16), (16, 20), (20, 32)))
            first = f"{info}<urn:uuid:{urn}>{CRLF}Content-Type: application/warc-fields{CRLF}Content-Length: {len(fields)}{CRLF * 2}{fields}"
            return pa.RecordBatch.from_arrays([pa.array([(CRLF * 2).join([first, *held])])], ["value"])

        for batch in batches:
            for value in batch.column(0):
                text = value.as_py()
                if held and size + len(text) > FILE_BYTES:
                    yield archive()
                    held, size = [], 0
                held.append(text)
                size += len(text)
        if held:
            yield archive()

    written = resolved.select(record.alias("value")).mapInArrow(archives, "value string")
    written.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


HEADER = re.compile(rb"([\w-]+): ?(.*)")


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of an archive, by its content lengths."""
    at = 0
    while at < len(data):
        head, _, _ = data[at : (end := data.index(b"\r\n\r\n", at))].partition(b"\r\n\r\n")
        lines = head.split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {m[1].decode(): m[2].decode() for m in map(HEADER.fullmatch, lines[1:]) if m}
        at, n = end + 4, int(fields["Content-Length"])
        yield fields, data[at : at + n]
        at += n + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_id, record_type, payload_digest, payload, refers_to_record) of every response and revisit.

    A revisit has a null payload, a record without a page id or target line a null there; no files, no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_id", "record_type", "payload_digest", "payload", "refers_to_record"]
        kinds = [pa.int64(), *[pa.string()] * 4, pa.binary(), pa.string()]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names
            )

        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for f, block in parse_records(gzip.decompress(content.as_py())):
                    if f["WARC-Type"] not in ("response", "revisit"):
                        continue
                    payload = block.partition(b"\r\n\r\n")[2] if f["WARC-Type"] == "response" else None
                    page = f.get("WARC-Page-ID")
                    rows.append(
                        (
                            None if page is None else int(page),
                            f.get("WARC-Target-URI"),
                            f["WARC-Record-ID"],
                            f["WARC-Type"],
                            f["WARC-Payload-Digest"].removeprefix("sha1:"),
                            payload,
                            f.get("WARC-Refers-To"),
                        )
                    )
                    held += len(block)
                    if held > 1 << 22:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    schema = (
        "page_id long, url string, record_id string, record_type string, payload_digest string, payload binary, "
        "refers_to_record string"
    )
    return files.select("content").mapInArrow(run, schema)


def resolved_records(records: DataFrame) -> DataFrame:
    """Joins revisits to the responses they refer to: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    One row per record, null and repeated page ids included; a revisit whose response is missing has null bytes. No
    records, no rows. Only ids, digests and lengths are shuffled. A response's digest is that of the payload read, not of its header.
    """
    heads = materialize(
        records.select(
            "page_id",
            "record_id",
            "record_type",
            "refers_to_record",
            F.octet_length("payload").cast("long").alias("payload_bytes"),
            F.when(F.col("payload").isNotNull(), F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        ),
        "heads",
    )
    responses = heads.filter("record_type = 'response'")
    revisits = heads.filter("record_type = 'revisit'")
    wanted = revisits.select(F.col("refers_to_record").alias("record_id")).distinct()
    spread = (
        responses.join(wanted, "record_id", "left_semi")
        .groupBy(F.col("record_id").alias("refers_to_record"))
        .agg(F.max("payload_bytes").alias("bytes"), F.max("page_id").alias("refers_to"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    spread = materialize(spread, "responses")
    salted = revisits.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    found = salted.join(spread, ["refers_to_record", "salt"], "left").select(
        "page_id", F.col("bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"
    )
    return responses.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")
    ).unionByName(found)
