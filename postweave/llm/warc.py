"""WARC archives: a writer with identical-payload revisits and a splittable reader.

Writing. Of records with equal payloads of at least ``min_bytes`` bytes the one with the
largest id is the response, the others are revisits that refer to it. Each task writes one
archive, every record a gzip member of its own, under a temporary name that becomes final
when the file is complete; a task that runs again replaces its own file.

Reading. The files are cut into byte ranges. A task searches its range for the gzip magic,
validates a candidate by decoding it as far as the record's headers, and owns the records
that start inside its range, reading past the end for the last one. After a valid record
the next one is expected where its member ends; damaged bytes are searched again.

Files are opened through ``pyarrow.fs`` by URI, so any store that it knows can hold the
archives, and tasks never share local folders.

Defined cases: a null html is an empty payload, a null url leaves out the target URI (control
characters in a URL are percent-encoded). A null id ranks last. Rows that repeat the
winning id are responses too. URLs, headers and payloads of any length are read whole; a record is held by one task. Columns other
than id, URL and html are left out, whatever their names. An empty table writes no archive and reads as no rows. A
gzip member stored inside a payload without compression could be taken for a record at the
start of a range; the writer compresses every payload, and ``block_digest_ok`` tells.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postweave.llm.common import stored

MAGIC = b"\x1f\x8b\x08"
#: How a record begins, and what ends its headers.
MARK, BLANK = b"WARC/1.", b"\r\n\r\n"
SPLIT_BYTES = 8 << 20
TASK_BYTES = 128 << 20
CHUNK = 1 << 16
SALTS = 16
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORD_ID = "urn:page:"
READ_SCHEMA = ("file string, offset long, record_type string, page_id long, url string, payload binary, "
               "payload_bytes long, payload_digest string, refers_to long, block_digest_ok boolean")


def assign_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                    min_bytes: int = 1000) -> DataFrame:
    """Id, URL and html of pages with _digest, _bytes and _response: the id of the record that holds the payload."""
    payload = F.coalesce(F.encode(F.col(html_col), "UTF-8"), F.lit(b""))
    rows = pages.select(id_col, url_col, html_col).withColumn("_digest", F.sha1(payload)).withColumn("_bytes", F.octet_length(payload).cast("long"))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(F.col(id_col)), F.lit(SALTS)).cast("int"))
    keys = rows.filter(F.col("_bytes") >= min_bytes).select("_digest", F.col(id_col).alias("_id"))
    repeated = (keys.groupBy("_digest").agg(F.count("*").alias("_n"), F.max("_id").alias("_response"))
                .filter("_n > 1").drop("_n"))
    # A payload may hold a third of the pages: join salted copies of its one row.
    copies = stored(repeated, "repeated").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(copies, ["_digest", "_salt"], "left").drop("_salt")


def _headers(pairs: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in pairs) + "\r\n").encode()


def _record(page_id, url, payload: bytes, digest: str, size: int, refers_to) -> bytes:
    """One gzip member. A revisit holds the HTTP head only."""
    name = f"<{RECORD_ID}{'' if page_id is None else page_id}>"
    pairs = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", name),
             ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        pairs.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url)))
    block = HTTP_HEAD + (payload if refers_to is None else b"")
    pairs += [("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
              ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()),
              ("X-Payload-Length", str(size))]
    if refers_to is not None:
        pairs += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                  ("WARC-Refers-To", f"<{RECORD_ID}{refers_to}>")]
    pairs += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(_headers(pairs) + block + b"\r\n\r\n") + packer.flush()


def write_warc(assigned: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
               html_col: str = "html") -> DataFrame:
    """Write the pages of ``assign_revisits``; one row per archive: file, records, bytes."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, out, records, size = TaskContext.get(), None, 0, 0
        store, folder = pafs.FileSystem.from_uri(path)
        final = f"{folder}/part-{context.partitionId():06d}.warc.gz"
        draft = f"{folder}/.draft-{context.taskAttemptId()}"
        for batch in batches:
            for page_id, url, html, digest, length, response in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    store.create_dir(folder, recursive=True)
                    out = store.open_output_stream(draft, compression=None)
                refers_to = response if response is not None and response != page_id else None
                member = _record(page_id, url, (html or "").encode(), digest, length, refers_to)
                out.write(member)
                records, size = records + 1, size + len(member)
        if out is not None:
            out.close()
            store.move(draft, final)
            yield pa.RecordBatch.from_pydict({"file": [final], "records": [records], "bytes": [size]})

    columns = assigned.select(id_col, url_col, html_col, "_digest", "_bytes", "_response")
    return columns.mapInArrow(write, "file string, records long, bytes long")


class _Range:
    """A file read in chunks from a place, with a window of bytes in memory."""

    def __init__(self, source, start: int, size: int) -> None:
        self.source, self.at, self.size, self.window = source, start, size, b""

    def fill(self, least: int) -> bool:
        """Have ``least`` bytes in the window; False at the end of the file."""
        while len(self.window) < least and self.at + len(self.window) < self.size:
            self.source.seek(self.at + len(self.window))
            self.window += self.source.read(max(CHUNK, least - len(self.window)))
        return len(self.window) >= least

    def skip(self, count: int) -> None:
        self.window, self.at = self.window[count:], self.at + count


def _decode(source: _Range) -> tuple[bytes, int] | None:
    """The record that starts at the window, and its compressed length; None if the bytes
    are no gzip member whose text begins with complete WARC headers."""
    unpacker, parts, read, checked = zlib.decompressobj(31), [], 0, False
    head, tail = b"", b""
    try:
        while not unpacker.eof:
            more = source.fill(read + 1)
            if not more:
                return None
            chunk = source.window[read:read + CHUNK]
            parts.append(unpacker.decompress(chunk))
            read += len(chunk)
            if not checked:
                head += parts[-1][:len(MARK) - len(head)]
                if not MARK.startswith(head):
                    return None
                # Headers may be of any length; their end may lie across two chunks.
                checked = BLANK in tail + parts[-1]
                tail = (tail + parts[-1])[1 - len(BLANK):]
    except zlib.error:
        return None
    return (b"".join(parts), read - len(unpacker.unused_data)) if checked else None


def _parse(file: str, offset: int, data: bytes) -> dict | None:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        key, _, value = line.partition(":")
        fields[key.strip().lower()] = value.strip()
    if "warc-type" not in fields or not fields.get("content-length", "").isdigit():
        return None
    block = rest[:int(fields["content-length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    revisit = fields["warc-type"] == "revisit"

    def number(key: str) -> int | None:
        found = re.search(r"(-?\d+)>$", fields.get(key, ""))
        return int(found[1]) if found else None

    def digest_of(key: str) -> str | None:
        text = fields.get(key, "").removeprefix("sha1:")
        return base64.b32decode(text).hex() if text else None

    own = hashlib.sha1(payload).hexdigest()
    return {"file": file, "offset": offset, "record_type": fields["warc-type"],
            "page_id": number("warc-record-id"), "url": fields.get("warc-target-uri"),
            "payload": None if revisit else payload,
            "payload_bytes": int(fields["x-payload-length"]) if revisit and "x-payload-length" in fields else len(payload),
            "payload_digest": digest_of("warc-payload-digest") if revisit else own,
            "refers_to": number("warc-refers-to"),
            "block_digest_ok": hashlib.sha1(block).hexdigest() == digest_of("warc-block-digest")}


def records_in(source, file: str, start: int, end: int, size: int) -> Iterator[dict]:
    """The records of one file that start in [start, end)."""
    window = _Range(source, start, size)
    while window.at < end and window.fill(len(MAGIC)):
        if not window.window.startswith(MAGIC):
            found = window.window.find(MAGIC)
            window.skip(found if found >= 0 else len(window.window) - len(MAGIC) + 1)
            continue
        decoded = _decode(window)
        row = _parse(file, window.at, decoded[0]) if decoded else None
        if row is None:
            window.skip(1)
            continue
        yield row
        window.skip(decoded[1])


def read_warc(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, with_payload: bool = True,
              task_bytes: int = TASK_BYTES) -> DataFrame:
    """One row per record of all ``*.warc.gz`` below the folder, see READ_SCHEMA.

    The driver lists the files; their ranges are made in Spark and dealt to tasks of about ``task_bytes``, or
    to as many as there are cores. ``with_payload=False`` leaves payloads null once their digests are computed."""
    store, folder = pafs.FileSystem.from_uri(path)
    files = [(f.path, f.size) for f in store.get_file_info(pafs.FileSelector(folder, recursive=True, allow_not_found=True))
             if f.path.endswith(".warc.gz") and f.size]
    if not files:
        return spark.createDataFrame([], READ_SCHEMA)
    ranges = sum(-(-size // split_bytes) for _, size in files)
    tasks = max(min(ranges, spark.sparkContext.defaultParallelism * 4), -(-sum(size for _, size in files) // task_bytes))
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long")))
    splits = spark.createDataFrame(files, "file string, size long").select("file", "size", starts.alias("start"))
    splits = splits.select("file", "start", F.least(F.col("start") + split_bytes, "size").alias("end"), "size")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(path)
        schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()),
                            ("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()),
                            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                            ("refers_to", pa.int64()), ("block_digest_ok", pa.bool_())])
        held, weight = [], 0
        for batch in batches:
            for file, start, end, size in zip(*(c.to_pylist() for c in batch.columns)):
                with store.open_input_file(file) as source:
                    for row in records_in(source, file, start, end, size):
                        weight += len(row["payload"] or b"") if with_payload else 200
                        held.append(row if with_payload else row | {"payload": None})
                        if weight > 4 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, weight = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    return splits.repartition(tasks, "file", "start").mapInArrow(read, READ_SCHEMA)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Give revisits the payload of the response that they refer to."""
    held = records.filter("record_type = 'response'").select(
        F.col("page_id").alias("refers_to"), F.col("payload").alias("_held")).dropDuplicates(["refers_to"])
    return records.join(held, "refers_to", "left").withColumn(
        "payload", F.coalesce("payload", "_held")).drop("_held").select(records.columns)
