"""WARC archives: writing, reading, and resolving revisits of equal payloads."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.llm.shared import arrow_type, held, new_folder, open_fs, put_file, spread_join, table

VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records have no crawl time of their own; a fixed one keeps archives the same on every run.
DATE = "1970-01-01T00:00:00Z"
LEVEL = 1
READ = 1 << 20
HEADERS = "file string, offset long, page_id {0}, record_type string, record_id string, refers_to_record string, refers_to_page {0}, payload_digest string, payload_bytes long, target string"
IDS = ("page_id", "refers_to_page")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record_id(file: str, number: int) -> str:
    """The same for a record on every attempt, different for every other record of the folder."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file}#{number}')}>"


def clean(value: str) -> str:
    """A header value on one line: CR and LF would end it."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def unclean(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(headers: list[tuple[str, str]], payload: bytes) -> bytes:
    """One record as a gzip member of its own, so that it can be read by its offset."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(payload)))])
    return gzip.compress(f"{VERSION}\r\n{head}\r\n".encode() + payload + b"\r\n\r\n", LEVEL, mtime=0)


def response_headers(rid: str, page_id, target: str | None, digest: str) -> list[tuple[str, str]]:
    own = [("WARC-Type", "response"), ("WARC-Record-ID", rid), ("WARC-Date", DATE), ("Content-Type", "text/html; charset=utf-8"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    return own + _names(page_id, target)


def revisit_headers(rid: str, page_id, target: str | None, digest: str, refers_record: str, refers_page) -> list[tuple[str, str]]:
    own = [("WARC-Type", "revisit"), ("WARC-Record-ID", rid), ("WARC-Date", DATE), ("WARC-Profile", PROFILE), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Refers-To", refers_record)]
    return own + _names(page_id, target) + ([("WARC-X-Refers-To-Page", clean(str(refers_page)))] if refers_page is not None else [])


def _names(page_id, target: str | None) -> list[tuple[str, str]]:
    return ([("WARC-Target-URI", clean(target))] if target is not None else []) + ([("WARC-X-Page-ID", clean(str(page_id)))] if page_id is not None else [])


def members(source) -> Iterator[tuple[int, bytes]]:
    """(offset, uncompressed bytes) of each gzip member of an open file, one at a time."""
    waiting, at, start = b"", 0, 0
    unzip, parts = zlib.decompressobj(31), []
    while True:
        if not waiting:
            waiting = source.read(READ)
            if not waiting:
                if parts:
                    raise ValueError("archive cut short")
                return
        before = len(waiting)
        parts.append(unzip.decompress(waiting))
        waiting = unzip.unused_data
        at += before - len(waiting)
        if unzip.eof:
            yield start, b"".join(parts)
            unzip, parts, start = zlib.decompressobj(31), [], at


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k: v for k, _, v in (line.partition(": ") for line in lines)}
    length = int(headers["Content-Length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return headers, rest[:length]


def header_schema(id_type: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64()}
    return pa.schema([(n, arrow_type(id_type) if t == "{0}" else kinds[t]) for n, t in (x.split() for x in HEADERS.split(", "))])


def arrow_batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    """Rows with ids as text, cast to the columns' types."""
    text = pa.schema([(f.name, pa.string() if f.name in IDS else f.type) for f in schema])
    return pa.RecordBatch.from_pylist(rows, schema=text).cast(schema)


def text_of(value) -> str | None:
    return None if value is None else str(value)


def shown(headers: dict[str, str], name: str) -> str | None:
    return unclean(headers[name]) if name in headers else None


def write_responses(pages: DataFrame, folder: str) -> DataFrame:
    """Writes every page as a response record, a file a partition; returns the records' headers.

    A null html is an empty payload. The payload stays in the files: later steps shuffle headers only.
    """
    id_type = pages.schema["page_id"].dataType.simpleString()
    schema = header_schema(id_type)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"raw-{context.partitionId():06d}.warc.gz"
        headers: list[pa.RecordBatch] = []

        def content():
            at = number = 0
            for batch in batches:
                rows = []
                for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                    payload = (html or "").encode()
                    digest, rid = digest_of(payload), record_id(f"{folder}/{name}", number)
                    packed = record(response_headers(rid, page_id, url, digest), payload)
                    rows.append({"file": f"{folder}/{name}", "offset": at, "page_id": text_of(page_id), "record_type": "response", "record_id": rid, "payload_digest": digest, "payload_bytes": len(payload), "target": url})
                    at, number = at + len(packed), number + 1
                    yield packed
                headers.append(arrow_batch(rows, schema))

        put_file(f"{folder}/{name}", content(), context.taskAttemptId())
        yield from headers

    return held(pages.select("page_id", "url", "html").mapInArrow(write, HEADERS.format(id_type)))


def roles(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """headers with _first (record id), _first_page of the record that has each payload.

    Of equal payloads of at least min_bytes that is the one of the largest page_id; a null page_id counts as the
    smallest, and of equal ids the earliest record (by file and offset) is taken. A shorter payload is its own first.
    """
    groups = headers.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("_page"), F.count(F.lit(1)).alias("_n"))
    groups = groups.where("_n > 1").select("payload_digest", "payload_bytes", F.col("_page").alias("_first_page"))
    # among the records of that page_id, the earliest
    tops = spread_join(headers, groups, ["payload_digest", "payload_bytes"], ["file", "offset"]).where(F.col("page_id").eqNullSafe(F.col("_first_page")))
    firsts = tops.groupBy("payload_digest", "payload_bytes", "_first_page").agg(F.min(F.struct("file", "offset", "record_id")).alias("_place"))
    firsts = held(firsts.select("payload_digest", "payload_bytes", "_first_page", F.col("_place.record_id").alias("_first")))
    return spread_join(headers, firsts, ["payload_digest", "payload_bytes"], ["file", "offset"], "left")


def write_resolved(headers: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Rewrites the archives of ``headers`` with revisits in place of repeated payloads; returns (file, records).

    What goes to a task is a file's headers and their roles; the task reads that file's records in their order and writes
    the new file with fresh headers. A revisit refers to the new record of its payload's response, whose id follows
    from the old one, so no file waits for another.
    """
    judged = roles(headers, min_bytes).select("file", "offset", "record_id", "_first", "_first_page")
    # a task may have much to rewrite for few headers: files are dealt by their number over as many tasks as there may be
    spark = headers.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    number = F.regexp_extract("file", r"raw-(\d+)\.warc\.gz$", 1).cast("int")
    dealt = judged.repartitionById(tasks, F.pmod(number, F.lit(tasks))).sortWithinPartitions("file", "offset")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, current, rows = TaskContext.get().taskAttemptId(), None, []

        def finish() -> pa.RecordBatch:
            target = f"{folder}/{current.rpartition('/')[2].replace('raw-', 'part-')}"
            put_file(target, content(), attempt)
            return pa.RecordBatch.from_pydict({"file": [target], "records": pa.array([len(rows)], pa.int64())})

        def content():
            system, local = open_fs(current)
            with system.open_input_stream(local, compression=None) as source:
                for (offset, raw), row in zip(members(source), rows, strict=True):
                    headers, payload = parse(raw)
                    if offset != row["offset"] or headers["WARC-Record-ID"] != row["record_id"]:
                        raise ValueError("headers don't fit their archive")
                    rid, digest = fresh_id(row["record_id"]), headers["WARC-Payload-Digest"].partition(":")[2]
                    page, url = shown(headers, "WARC-X-Page-ID"), shown(headers, "WARC-Target-URI")
                    if row["_first"] in (None, row["record_id"]):
                        yield record(response_headers(rid, page, url, digest), payload)
                    else:
                        yield record(revisit_headers(rid, page, url, digest, fresh_id(row["_first"]), row["_first_page"]), b"")

        for batch in batches:
            for row in batch.to_pylist():
                if row["file"] != current:
                    if current is not None:
                        yield finish()
                    current, rows = row["file"], []
                rows.append(row)
        if current is not None:
            yield finish()

    return held(dealt.mapInArrow(rewrite, "file string, records long"))


def fresh_id(rid: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, rid)}>"


def read_headers(files: DataFrame, id_type: str = "bigint", check: bool = True) -> DataFrame:
    """Every record's headers in the archives listed in files.file; a response's payload is held against its digest."""
    schema = header_schema(id_type)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("file").to_pylist():
                system, local = open_fs(file)
                rows: list[dict] = []
                with system.open_input_stream(local, compression=None) as source:
                    for offset, raw in members(source):
                        headers, payload = parse(raw)
                        digest = headers["WARC-Payload-Digest"].partition(":")[2]
                        kind = headers["WARC-Type"]
                        if check and kind == "response" and digest_of(payload) != digest:
                            raise ValueError(f"{file} at {offset}: the payload has another digest")
                        rows.append({
                            "file": file, "offset": offset, "page_id": shown(headers, "WARC-X-Page-ID"), "record_type": kind, "record_id": headers["WARC-Record-ID"],
                            "refers_to_record": headers.get("WARC-Refers-To"), "refers_to_page": shown(headers, "WARC-X-Refers-To-Page"), "payload_digest": digest,
                            "payload_bytes": len(payload) if kind == "response" else None, "target": shown(headers, "WARC-Target-URI"),
                        })
                        if len(rows) == 4096:
                            yield arrow_batch(rows, schema)
                            rows = []
                if rows:
                    yield arrow_batch(rows, schema)

    spark = files.sparkSession
    dealt = files.select("file").repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "file")
    return dealt.mapInArrow(read, HEADERS.format(id_type))


def resolved(headers: DataFrame) -> DataFrame:
    """Joins revisits to the responses they refer to: their payload_bytes and refers_to (a page_id) are the response's."""
    headers = held(headers)
    responses = headers.where("record_type = 'response'")
    origin = responses.select(F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("_bytes"))
    revisits = headers.where("record_type = 'revisit'").drop("payload_bytes")
    found = spread_join(revisits, origin, ["refers_to_record"], ["record_id"])
    same = found.select("page_id", F.col("_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "target", "file", "offset")
    own = responses.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast(headers.schema["page_id"].dataType).alias("refers_to"), "target", "file", "offset")
    return own.unionByName(same)


def archive_pages(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Archives pages (page_id, url, html) in folder with repeated payloads as revisits; returns the files written.

    Equal rows are records of their own. Other columns are not read.
    """
    return write_resolved(write_responses(pages, f"{folder}/raw"), f"{folder}/archive", min_bytes)


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    files = archive_pages(pages, new_folder(spark, "warc"))
    return resolved(read_headers(files, pages.schema["page_id"].dataType.simpleString())).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target")


OP2_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS hex FROM pages),
     d AS (SELECT page_id, url AS target, octet_length(encode(h)) AS payload_bytes, array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([15, 10, 5, 0],
                  lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, i * 5 + 1, 5))::INT >> s) & 31) + 1, 1)), '')), '') AS payload_digest FROM p),
     m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to, target FROM m
"""
