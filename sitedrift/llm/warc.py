"""WARC records in ZIP packages: written by Spark tasks, found by their indexes, read by byte range.

A package holds two stored members: ``archive/data.warc.gz``, each record a gzip member of its own, and
``indexes/index.cdxj``, a line ``record-id offset length`` for each. Packages go to a shared folder through
``pyarrow.fs``, under a name of the task's own and then renamed, so that a task run again replaces its file with an
equal one. Readers parse the (ZIP64) directories, locate both members and read single records by position.

Of pages with equal payloads of at least ``min_bytes``, the one with the largest id is a response and the others are
revisits that name it. Defined results: null html is the empty payload; a null url is the empty target; control
characters of a url are percent-escaped; a page without an id is a record named ``none`` and is read back without one: it
revisits the largest id of its payload, and is a response where no page of that payload has an id; rows that repeat an
id and payload are written again as their own records; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import partitions, stored
from .zipfmt import Package, data_at, directory

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: A package is closed once its records reach this size, which bounds a task's memory.
PACKAGE_BYTES = 32 << 20
#: Fixed values of the WARC format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

RECORD_SCHEMA = (
    "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long,"
    " payload binary"
)


NAMELESS = "none"


def record_id(page_id: int | str | None) -> str:
    return f"<urn:x-page:{NAMELESS if page_id is None else page_id}>"


def page_of(uri: str) -> int | None:
    name = uri.strip("<>").rpartition(":")[2]
    return None if name == NAMELESS else int(name)


def make_record(page_id: int | str | None, url: str | None, payload: bytes, refers_to: int | str | None) -> bytes:
    """One record as its own gzip member; a revisit has the HTTP header of its payload, not the payload."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 1, mtime=0)


def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def parse_record(raw: bytes) -> dict:
    """A row of RECORD_SCHEMA from one record's gzip member; payload is None for revisits."""
    head, _, rest = gzip.decompress(raw).partition(b"\r\n\r\n")
    h = _headers(head)
    http, _, payload = rest[: int(h["content-length"])].partition(b"\r\n\r\n")
    revisit = h["warc-type"] == "revisit"
    return {
        "page_id": page_of(h["warc-record-id"]),
        "url": h["warc-target-uri"],
        "record_type": h["warc-type"],
        "payload_bytes": int(_headers(http)["content-length"]) if revisit else len(payload),
        "payload_digest": h["warc-payload-digest"].removeprefix("sha1:")
        if revisit
        else base64.b32encode(hashlib.sha1(payload).digest()).decode(),
        "refers_to": page_of(h["warc-refers-to"]) if revisit else None,
        "payload": None if revisit else payload,
    }


def with_originals(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload (binary), refers_to: the largest page id of an equal payload, null for that page itself.

    Payloads are never dealt by their digest: ids and digests alone find the pages that repeat one, and what these refer
    to joins the pages by page id and digest. So a payload that many pages share meets in no task but as ids.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url"),
        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("_key", F.when(F.length("payload") >= min_bytes, F.sha2("payload", 256)))
    repeated = (
        rows.where(F.col("_key").isNotNull())
        .groupBy("_key")
        .agg(F.max("page_id").alias("_last"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .drop("_n")
        .where("_last IS NOT NULL")
    )
    again = rows.select("page_id", "_key").join(repeated, "_key").where(~F.col("_last").eqNullSafe(F.col("page_id"))).distinct()
    again = again.select(F.col("page_id").alias("_id"), F.col("_key").alias("_same"), "_last")
    joined = rows.join(again, (F.col("_key") == F.col("_same")) & F.col("page_id").eqNullSafe(F.col("_id")), "left")
    return joined.select("page_id", "url", "payload", F.col("_last").alias("refers_to"))


def write_packages(records: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes rows (page_id, url, payload, refers_to) below folder, a URI; returns (path, n_records) of each package.

    The result is lazy and must be run once: checkpoint it before further use.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        part, made = TaskContext.get().partitionId(), []
        data, index, number = io.BytesIO(), [], 0

        def close() -> None:
            nonlocal data, index, number
            name = f"part-{part:06d}-{number:04d}.zip"
            temp = f"{root}/.{name}.{uuid.uuid4().hex}"
            with fs.open_output_stream(temp) as out:
                package = Package(out)
                package.add(ARCHIVE, data.getvalue())
                package.add(INDEX, "".join(index).encode())
                package.close()
            fs.move(temp, f"{root}/{name}")
            made.append((f"{root}/{name}", len(index)))
            data, index, number = io.BytesIO(), [], number + 1

        for b in batches:
            for page_id, url, payload, refers in zip(b["page_id"], b["url"], b["payload"], b["refers_to"], strict=True):
                raw = make_record(page_id, url, payload, refers)
                index.append(f"{record_id(page_id)} {data.tell()} {len(raw)}\n")
                data.write(raw)
                if data.tell() >= package_bytes:
                    close()
        if index:
            close()
        yield pd.DataFrame(made, columns=["path", "n_records"])

    # as texts: pandas has no whole numbers beside nulls
    named = [F.col(c).cast("string").alias(c) for c in ("page_id", "refers_to")]
    return records.select(named[0], "url", "payload", named[1]).mapInPandas(run, "path string, n_records long")


class _File:
    def __init__(self, handle):
        self.handle = handle

    def size(self) -> int:
        return self.handle.size()

    def read_at(self, n: int, at: int) -> bytes:
        self.handle.seek(at)
        return self.handle.read(n)


def read_packages(packages: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Rows of RECORD_SCHEMA of every record of the packages (column path) below folder; each is read by its range."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for path in b["path"]:
                with fs.open_input_file(path) as handle:
                    source = _File(handle)
                    members = {m.name: m for m in directory(source)}
                    begin = data_at(source, members[ARCHIVE])
                    index = source.read_at(members[INDEX].size, data_at(source, members[INDEX])).decode()
                    rows, size = [], 0
                    for line in index.splitlines():
                        _, at, n = line.rsplit(" ", 2)
                        row = parse_record(source.read_at(int(n), begin + int(at)))
                        size += row["payload_bytes"]
                        if not payloads:
                            row["payload"] = None
                        rows.append(row)
                        if len(rows) >= 1000 or size > 8 << 20:
                            yield _frame(rows)
                            rows, size = [], 0
                    if rows:
                        yield _frame(rows)

    return packages.select("path").mapInPandas(run, RECORD_SCHEMA)


def _frame(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows)
    return out.assign(**{c: pd.array([r[c] for r in rows], "Int64") for c in ("page_id", "refers_to")})


def archive_and_read(pages: DataFrame, folder: str, min_bytes: int = 0, payloads: bool = True) -> DataFrame:
    """Writes all pages as packages below a fresh folder, then reads their records back."""
    packages = stored(write_packages(with_originals(pages, min_bytes), folder), "packages")
    return read_packages(packages.repartition(partitions(pages.sparkSession)), folder, payloads)
