"""WARC archives with an index written first: offset, length, url and digest of each record.

Records are gzip members of their own, so any of them can be read by its byte range.  A response holds an HTTP block with the page's html as
its payload; a page whose payload another page answers is written as a revisit with the HTTP head alone, which names the record that it
refers to.  Payloads are equal when their SHA-256 digests are; the SHA-1 digest, for which different payloads can be made, is only
recorded.  Only pages whose payload occurs more than once are shuffled.

Archives are written and read by the executors through Arrow filesystems, to a folder that all of them share; every attempt of a
task writes a file of its own, and only files that the committed index names count, so lost executors leave nothing but unreferenced files.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import fresh_path, sieve, staged

INDEX = "page_id long, url string, digest string, kind string, file string, offset long, length long"
#: Ranges closer than GAP bytes are read together, up to READ bytes at a time; one task reads about SPAN bytes of a file.
GAP, READ, SPAN = 1 << 16, 1 << 23, 1 << 26


def opened(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def record_id(page_id: int | None, key: bytes, turn: int) -> str:
    """The id of the `turn`-th record of a page id and payload."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {key.hex()} {turn}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, turn: int, date: str, refers: int | None, revisit: bool) -> tuple[bytes, str]:
    """One WARC record and its payload digest."""
    key, digest = hashlib.sha256(payload).digest(), base32_sha1(payload)
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, key, turn)}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-Id: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers, key, 1)}", f"X-Refers-To-Page-Id: {'' if refers is None else refers}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", digest


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers of one gzip member, and the payload behind its HTTP head."""
    head, _, rest = zlib.decompress(raw, 31).partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    return fields, rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, date: str | None = None) -> DataFrame:
    """Write one record for each row under `folder`; the index of all records.

    Payload: the html in UTF-8 (null: empty), of any length.  Of rows with equal payloads of at least `least` bytes the one with the largest
    id (null ids last; one of them, if rows repeat) is the response and the others revisit it.  Every row, repeated ones included, has a
    record of its own.  `date`: of all records, by default the time of the call.  An empty table writes nothing; other columns are not read.
    """
    date = date or datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(folder)
        fs.create_dir(root, recursive=True)
        path, at, out = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in batches:
            rows = []
            for page_id, url, html, revisit, refers, turn in zip(*batch.columns):
                page_id, url, revisit = page_id.as_py(), url.as_py(), revisit.as_py()
                made, digest = record(page_id, url, (html.as_py() or "").encode(), turn.as_py(), date, refers.as_py(), revisit)
                out = out or fs.open_output_stream(path, compression=None)
                data = member(made)
                out.write(data)
                rows.append((page_id, url, digest, "revisit" if revisit else "response", path, at, len(data)))
                at += len(data)
            columns = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))], [f.split()[0] for f in INDEX.split(", ")])
        if out:
            out.close()

    lost = F.lit(-(1 << 63))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    payload = F.coalesce("html", F.lit(""))
    rows = rows.withColumns({"key": F.coalesce("page_id", lost), "sha": F.unhex(F.sha2(payload, 256))})
    slim = rows.select("key", "sha", F.octet_length(payload).alias("size"))
    groups = slim.groupBy("sha").agg(F.max("key").alias("refers"), F.count("*").alias("n"), F.max("size").alias("size")).filter("n > 1").select("sha", F.when(F.col("size") >= least, F.col("refers")).alias("refers"))
    groups = staged(groups, "warc-groups")
    # Whatever is certainly not repeated is written where it is read; the sieve lets few other pages into the shuffle.
    rows = sieve(rows, groups, ["sha"], "near")
    first = F.row_number().over(Window.partitionBy("key", "sha").orderBy("url"))
    some = rows.filter("near").join(groups.withColumn("repeats", F.lit(True)), "sha", "left").withColumn("turn", first)
    revisit = F.col("repeats") & F.col("refers").isNotNull() & ~((F.col("key") == F.col("refers")) & (F.col("turn") == 1))
    some = some.select("page_id", "url", "html", F.coalesce(revisit, F.lit(False)).alias("revisit"), F.when(F.col("refers") > lost, F.col("refers")).alias("refers"), "turn")
    alone = rows.filter("not near").select("page_id", "url", "html", F.lit(False).alias("revisit"), F.lit(None).cast("long").alias("refers"), F.lit(1).alias("turn"))
    return staged(alone.unionByName(some).mapInArrow(write, INDEX), "warc-index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to of the records that `index` selects.

    Offsets are sorted within a span of a file, ranges near each other are read at once, and payloads leave in batches of what one
    read brought.  The payload of a revisit is null; its bytes and digest are those of the whole payload.  A response whose payload does not
    have its digest raises.  An empty index reads nothing; records that it names twice are read twice.
    """
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())

    def fields(raw: bytes, at: int) -> tuple:
        head, body = parsed(raw)
        digest, size, response = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"]), head["WARC-Type"] == "response"
        if response and (base32_sha1(body) != digest or len(body) != size):
            raise ValueError(f"record at {at} does not have its digest")
        page, refers = head["X-Page-Id"], head.get("X-Refers-To-Page-Id")
        return int(page) if page else None, head["WARC-Target-URI"], body if response else None, size, digest, head["WARC-Type"], int(refers) if refers else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(folder)

        def fetched(path: str, run: list[tuple[int, int]]) -> pa.RecordBatch:
            base, end = run[0][0], max(at + n for at, n in run)
            with fs.open_input_file(path) as f:
                f.seek(base)
                data = f.read(end - base)
            rows = [fields(data[at - base : at - base + n], at) for at, n in run]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        path, run = None, []
        for batch in batches:
            for file, at, n in zip(*(c.to_pylist() for c in batch.columns)):
                if run and (file != path or at - run[-1][0] - run[-1][1] > GAP or at + n - run[0][0] > READ):
                    yield fetched(path, run)
                    run = []
                path = file
                run.append((at, n))
        if run:
            yield fetched(path, run)

    spans = index.withColumn("span", F.floor(F.col("offset") / SPAN)).repartition("file", "span").sortWithinPartitions("file", "offset")
    return spans.select("file", "offset", "length").mapInArrow(read, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_folder(spark) -> str:
    return fresh_path(spark, "warc")
