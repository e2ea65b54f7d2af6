"""WARC archives: a deterministic sharded writer and a reader.

Records are cut into ranges of page_id by exact counts, so shards do not depend on how the input is laid
out; each range is sorted and written in order, rolled by compressed size, with headers and digests made
anew. Of records with equal payloads the one with the largest page_id is the response. Who revisits whom
is decided on (page_id, digest) alone and travels to the writer as small rows sorted next to the pages, so
pages are shuffled once. Files appear through temporary names and a manifest (files.py).
"""
from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm.common import range_bounds, small_batches, stored, with_range
from credence.llm.files import MANIFEST, RollingFiles, commit, read_files
from credence.operators.layout import cut_lineage
from credence.session import work_path

SHARD_BYTES = 32 << 20   # payload bytes of a range
ROLL_BYTES = 64 << 20    # compressed bytes after which a file ends
DATE = "2000-01-01T00:00:00Z"  # equal input gives equal bytes
SAME = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PRINTABLE = "".join(map(chr, range(0x21, 0x7F)))


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member holding one record."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head.encode() + block + b"\r\n\r\n") + pack.flush()


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def opening(name: str) -> bytes:
    return record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _id("info", name)), ("WARC-Date", DATE),
                   ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"software: credence\r\nformat: WARC File Format 1.1\r\n")


def page_record(page_id, url, payload: bytes, repeat: int, revisit: bool, refers) -> bytes:
    """A response, or a revisit that carries the HTTP head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    digest = _sha1(payload)
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _id("page", page_id, digest, repeat)), ("WARC-Date", DATE),
        ("WARC-Target-URI", quote(url, safe=PRINTABLE) if url else f"urn:page:{page_id}"),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{_sha1(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if page_id is not None:
        fields.append(("WARC-X-Page-ID", str(page_id)))
    if revisit:
        fields += [("WARC-Profile", SAME), ("WARC-Refers-To", _id("page", refers, digest, 0))]
        if refers is not None:
            fields.append(("WARC-X-Refers-To-Page-ID", str(refers)))
    return record(fields, block)


def write_warc(pages: DataFrame, root: str, key: str = "page_id", url: str = "url", html: str = "html",
               min_bytes: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write the pages below `root`; returns the manifest.

    A null html is empty. Payloads of at least `min_bytes` that are equal share one response. Rows that repeat
    a page_id and payload: the first is written as such, the others revisit it. A null page_id sorts first and
    counts as smaller than any. A null url gives a urn; other url characters than printable ASCII are
    percent-encoded. Other columns are not read. An empty table writes no file.
    """
    spark = pages.sparkSession
    small_batches(spark)
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"),
                        F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumns({"digest": F.unhex(F.sha1("payload")), "size": F.octet_length("payload")})
    narrow = stored(rows.select("page_id", "digest", "size"), "page-digests")
    bounds = range_bounds(narrow, "page_id", "size", shard_bytes)
    groups = cut_lineage(narrow.filter(F.col("size") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("refers"), F.count("*").alias("n"))
                         .filter("n > 1").drop("n"))
    decisions = narrow.join(groups, "digest").filter("refers IS NOT NULL AND (page_id IS NULL OR page_id < refers)").select(
        "page_id", "digest", "refers").distinct()
    both = (rows.select("page_id", "digest", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("refers"), "url", "payload")
            .unionByName(decisions.select("page_id", "digest", F.lit(0).alias("kind"), "refers",
                                          F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"))))
    laid = (with_range(both, "page_id", bounds, "shard").repartitionByRange(len(bounds) + 1, "shard")
            .sortWithinPartitions("shard", "page_id", "digest", "kind", "url"))

    def run(batches):
        files = RollingFiles(root, roll_bytes, ".warc.gz", opening)
        shard, same, repeat, decided = None, None, 0, (None, None)
        for pdf in batches:
            ids = pdf["page_id"].astype("Int64").tolist()
            refs = pdf["refers"].astype("Int64").tolist()
            for s, page, digest, kind, ref, link, payload in zip(
                    pdf["shard"].tolist(), ids, pdf["digest"], pdf["kind"].tolist(), refs, pdf["url"], pdf["payload"]):
                page, ref, digest = (None if page is pd.NA else page), (None if ref is pd.NA else ref), bytes(digest)
                if s != shard:
                    files.end()
                    shard = s
                if kind == 0:
                    decided = ((page, digest), ref)
                    continue
                repeat = repeat + 1 if same == (page, digest) else 0
                same = (page, digest)
                revisit = decided[0] == same or (repeat > 0 and len(payload) >= min_bytes)
                refers = decided[1] if decided[0] == same else page
                files.write(s, page_record(page, link, bytes(payload), repeat, revisit, refers))
            yield from files.manifest()
        files.end()
        yield from files.manifest()

    return commit(spark, laid.mapInPandas(run, MANIFEST), root)


def records(stream):
    """Yield (headers by lower-case name, block) of every record of an open .warc.gz file."""
    with gzip.GzipFile(fileobj=stream) as f:
        while True:
            line = f.readline()
            if not line:
                return
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no WARC record: {line[:40]!r}")
            head = {}
            while (line := f.readline().strip()):
                k, _, v = line.partition(b":")
                head[k.strip().lower().decode()] = v.strip().decode()
            n = int(head["content-length"])
            block = f.read(n)
            if len(block) != n or f.read(4) != b"\r\n\r\n":
                raise ValueError("broken WARC record")
            yield head, block


SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def read_warc(manifest: DataFrame, root: str, payload: bool = False) -> DataFrame:
    """A row per page record; digests are checked. payload: add the bytes (null for revisits)."""
    def parse(stream):
        rows = []
        size = 0
        for head, block in records(stream):
            if head["warc-type"] not in ("response", "revisit"):
                continue
            http, _, body = block.partition(b"\r\n\r\n")
            full = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
            digest = head["warc-payload-digest"].removeprefix("sha1:")
            answer = head["warc-type"] == "response"
            if answer and (len(body) != full or _sha1(body) != digest) or _sha1(block) != head["warc-block-digest"].removeprefix("sha1:"):
                raise ValueError(f"digest of {head['warc-record-id']} does not match")
            page, refers = head.get("warc-x-page-id"), head.get("warc-x-refers-to-page-id")
            row = (page and int(page), head["warc-target-uri"], head["warc-type"], refers and int(refers), full, digest)
            rows.append((*row, body if answer else None) if payload else row)
            size += len(block)
            if len(rows) >= 1000 or (payload and size >= 8 << 20):
                yield frame(rows)
                rows, size = [], 0
        if rows:
            yield frame(rows)

    names = [x.split()[0] for x in SCHEMA.split(", ")] + ["payload"] * payload

    def frame(rows):
        return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    return read_files(manifest, root, SCHEMA + ", payload binary" * payload, parse)


def archive(pages: DataFrame, root: str | None = None, **options) -> DataFrame:
    """Write the pages and read the archives back."""
    root = root or work_path(pages.sparkSession, "warc")
    return read_warc(write_warc(pages, root, **options), root)
