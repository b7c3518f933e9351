"""WARC archives, index first.

`write` makes one WARC/1.1 record a page, each its own gzip member, in files of about FILE bytes in a folder that the
driver and all executors share, and an index with a row for each record: file, offset, length, url, digest and the
identity of the record it revisits. `read` selects records from the index, sorts their byte ranges, coalesces ranges
that lie next to each other (or at most GAP bytes apart) up to RANGE bytes, reads each such range once, and takes the
records from it. Everything that it returns is the record's own: page_id, url and the page that a revisit refers to
stand in headers, exactly, and `checked` compares them with the record's identities, its lengths and its digest.

Which payloads are the same is settled before writing, from digest and length alone: of the records with equal payloads
of at least LEAST bytes the one with the largest page_id is the response, the others are revisits with the HTTP headers
but without the payload. Counting copies is a partial aggregate, the copied digests are a written table (so a digest
that a third of all pages share is a large partition of a plain join, which adaptive execution splits), and the pages are
dealt by page_id, so no payload's copies gather in one task.

A file's name is new for every attempt of a task and only files named by the committed index are read, so lost
executors and repeated attempts leave nothing that is seen.

Defined cases: null html is an empty payload; an empty or null url is written as "urn:page:<page_id>" and read back as
it was; rows that repeat the page_id of a response, with its payload, are responses too; among rows without a page_id
only those whose group has no page_id at all are responses; an empty table gives no files and no rows; extra columns
are ignored; a record that was changed after it was written is an error.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import clashing, cut, file_system, keys, longs, new_folder

LEAST = 1000
FILE, RANGE, GAP = 256_000_000, 16_000_000, 64_000
#: Bytes of payloads that `read` hands on at once.
OUT = 8_000_000
DATE = "2024-01-01T00:00:00Z"
INDEX = "file string, offset long, length long, page_id long, url string, payload_bytes long, digest string, record_type string, refers_to long"
ROW = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def target(page_id: int | None, url: str | None) -> str:
    """The URI of a record: the page's url, without line ends, or a name of its own."""
    return url.replace("\r", "%0D").replace("\n", "%0A") if url else f"urn:page:{page_id}"


def to_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member. digest: the payload's SHA-1 in hex."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target(page_id, url)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http;msgtype=response",
    ]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
    head.append(f"Page: {json.dumps([page_id, url, refers_to])}")
    block = http if revisit else http + payload
    head.append(f"Content-Length: {len(block)}")
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + press.flush()


def from_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one gzip member."""
    whole = zlib.decompress(raw, 31)
    head, _, rest = whole.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError(f"no WARC record: {lines[0]!r}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    if rest[int(fields["Content-Length"]) :] != b"\r\n\r\n":
        raise ValueError("a record's Content-Length is not that of its block")
    block = rest[:-4]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def checked(raw: bytes) -> tuple[int | None, str | None, int, str, str, int | None, bytes | None]:
    """page_id, url, payload_bytes, digest, record type, refers_to and (for a response) payload of one gzip member;
    what the record says twice has to agree."""
    fields, http, payload = from_record(raw)
    page, url, refers = json.loads(fields["Page"])
    size, kind = int(http["Content-Length"]), fields["WARC-Type"]
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if fields["WARC-Record-ID"] != record_id(page, digest) or fields["WARC-Target-URI"] != target(page, url):
        raise ValueError(f"the record of page {page} has another page's identity or URI")
    if kind == "revisit":
        if payload or fields["WARC-Refers-To"] != record_id(refers, digest):
            raise ValueError(f"the revisit of page {page} has a payload or refers to another record than page {refers}")
        return page, url, size, digest, kind, refers, None
    if kind != "response" or refers is not None or len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"the payload of page {page} differs from its length, digest or type")
    return page, url, size, digest, kind, None, payload


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes pages(page_id, url, html) to files in folder and returns the index (a table in the shared folder)."""
    pages = clashing(pages, ["page_id", "url", "html"]).withColumn("page_id", F.col("page_id").cast("long"))
    html = F.coalesce("html", F.lit(""))
    pages = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).cast("long").alias("bytes"))
    light = pages.select("page_id", "digest", "bytes").where(F.col("bytes") >= LEAST)
    same = cut(light.groupBy("digest", "bytes").agg(F.max("page_id").alias("response"), F.count("*").alias("copies")).where("copies > 1 AND response IS NOT NULL"), "warc-copied")
    # light rows only: which page revisits which
    revisits = light.join(same, ["digest", "bytes"]).where("NOT page_id <=> response").select(F.col("page_id").alias("rid"), F.col("digest").alias("rdigest"), "response").distinct()
    # the light side is hashed, so pages are dealt but not sorted
    typed = pages.join(revisits.hint("shuffle_hash"), pages["page_id"].eqNullSafe(F.col("rid")) & (F.col("digest") == F.col("rdigest")), "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, at = file_system(folder)
        fs.create_dir(at, recursive=True)
        out, rows, size, name = None, [], 0, ""

        def index() -> pd.DataFrame:
            columns = dict(zip([c.split()[0] for c in INDEX.split(", ")], zip(*rows, strict=True), strict=True))
            return pd.DataFrame(columns | {c: longs(columns[c]) for c in ("page_id", "refers_to")})

        try:
            for b in batches:
                for page, url, html, digest, response in zip(b["page_id"], b["url"], b["html"], b["digest"], b["response"], strict=True):
                    page, refers = (None if x is None else int(x) for x in (page, response))
                    payload = html.encode("utf-8", "surrogatepass")
                    raw = to_record(page, url, payload, digest, refers)
                    if out is None:
                        name, size, rows = f"{uuid.uuid4().hex}.warc.gz", 0, []
                        out = fs.open_output_stream(f"{at}/{name}", compression=None)  # records are members already
                    out.write(raw)
                    rows.append((name, size, len(raw), page, url, len(payload), digest, "response" if refers is None else "revisit", refers))
                    size += len(raw)
                    if size >= FILE:
                        out.close()
                        out = None
                        yield index()
            if out is not None:
                out.close()
                out = None
                yield index()
        finally:
            if out is not None:
                out.close()

    return cut(keys(typed.select("page_id", "url", "html", "digest", "response"), "page_id", "response").mapInPandas(run, INDEX), "warc-index")


def read(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of an index (or of any selection of its rows), read from the files in folder. Without payloads only
    what was worked out from them comes back from the executors' Python."""
    # a file's records by the RANGE in which they begin: bounded rows, each a run of neighbouring bytes
    tasks = index.groupBy("file", F.floor(F.col("offset") / RANGE).alias("part")).agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records"))
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads

    def frame(rows: list[tuple]) -> pd.DataFrame:
        columns = dict(zip(names, zip(*rows, strict=True), strict=False))
        return pd.DataFrame(columns | {c: longs(columns[c]) for c in ("page_id", "refers_to")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, at = file_system(folder)
        for b in batches:
            for name, records in zip(b["file"], b["records"], strict=True):
                ranges: list[list] = []
                for r in records:
                    if ranges and r["offset"] <= ranges[-1][1] + GAP:
                        ranges[-1][1] = max(ranges[-1][1], r["offset"] + r["length"])
                        ranges[-1][2].append(r)
                    else:
                        ranges.append([r["offset"], r["offset"] + r["length"], [r]])
                with fs.open_input_file(f"{at}/{name}") as f:
                    for start, end, found in ranges:
                        f.seek(start)
                        raw, rows, size = memoryview(f.read(end - start)), [], 0
                        for r in found:
                            row = checked(raw[r["offset"] - start : r["offset"] - start + r["length"]])
                            rows.append(row if payloads else row[:-1])
                            size += len(row[-1] or b"") if payloads else 0
                            if size >= OUT:
                                yield frame(rows)
                                rows, size = [], 0
                        if rows:
                            yield frame(rows)

    # few rows, each megabytes of reading: a count keeps adaptive execution from joining them in one task
    spread = tasks.repartition(max(2, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return spread.mapInPandas(run, ROW + ", payload binary" * payloads)


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes pages and reads all records back: page_id, url, payload_bytes, payload_digest, record_type, refers_to."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    return read(write(pages, folder), folder, payloads=False)


SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, url, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
g AS (SELECT payload_digest, payload_bytes, max(page_id) AS response FROM d WHERE payload_bytes >= 1000 GROUP BY ALL HAVING count(*) > 1)
SELECT page_id, url, payload_bytes, payload_digest,
       CASE WHEN response IS NOT NULL AND page_id IS DISTINCT FROM response THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM response THEN response END AS refers_to
FROM d LEFT JOIN g USING (payload_digest, payload_bytes)
"""
