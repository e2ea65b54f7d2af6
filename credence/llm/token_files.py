"""Token ids in files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

All ids of the corpus are counted; the most frequent id gets rank 0. A rank takes 1 to 4 bytes, and four
lengths (2 bits each) make one control byte, so lengths stand apart from data and are decoded by table lookup.

File: blocks, one after another. Block: 4-byte magic, then little-endian unsigned 64-bit numbers of
documents, ids, ids before the block, data bytes; per document: a byte (1: has a doc_id), a signed 64-bit doc_id,
an unsigned 64-bit id count; the control bytes; the data bytes. `ranks.bin` beside the files holds the id of each
rank, unsigned 32-bit.
"""
from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm.common import map_texts, range_bounds, stored, with_range
from credence.llm.encoding import encoder
from credence.llm.files import MANIFEST, RollingFiles, commit, place, read_files
from credence.session import work_path

MAGIC = b"RVB1"
SHARD_IDS = 8_000_000
BLOCK_IDS = 1_000_000
ROLL_BYTES = 256 << 20
HEAD = "<4s4Q"
# by control byte: the four lengths
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + np.uint8(1)


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes)."""
    r = np.ascontiguousarray(ranks, "<u4")
    code = ((r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)).astype(np.uint8)
    padded = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    padded[:len(r)] = code
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    used = np.arange(4, dtype=np.uint8) <= code[:, None]
    return control.astype(np.uint8).tobytes(), r.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ranks: lengths by table lookup of the control bytes, values gathered byte by byte."""
    length = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(length, dtype=np.int64) - length
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(length > k)
        if not len(longer):
            break
        out[longer] |= raw[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


@lru_cache(1)
def _zstd():
    """One compressor and decompressor per worker process."""
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _shrink(ids: bytes) -> bytes:
    """Ids between the passes: 16 bits each where they fit, packed."""
    wide = np.frombuffer(ids, "<u4")
    small = len(wide) == 0 or int(wide.max()) < 65536
    body = wide.astype("<u2").tobytes() if small else ids
    return (b"\2" if small else b"\4") + _zstd()[0].compress(body)


def _grow(blob: bytes) -> np.ndarray:
    return np.frombuffer(_zstd()[1].decompress(blob[1:]), "<u2" if blob[:1] == b"\2" else "<u4").astype("<u4")


def encoded(docs: DataFrame, path: str, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, blob), stored: every document's ids with the end id. Null text: empty."""
    end = np.array([end_id], "<u4").tobytes()

    def work(texts):
        ids = [x + end for x in encoder(path, "byte").encode(texts)]
        return {"n_tokens": [len(x) // 4 for x in ids], "blob": [_shrink(x) for x in ids]}

    frame = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return stored(map_texts(frame, ["doc_id"], "doc_id long, n_tokens long, blob binary", work), "ids")


def rank_order(ids: DataFrame) -> np.ndarray:
    """Id of each rank, most frequent first (ties: smaller id), counted over all documents; as long as the vocabulary."""
    def count(batches):
        total = np.zeros(0, np.int64)
        for pdf in batches:
            if len(pdf):
                n = np.bincount(np.concatenate([_grow(bytes(x)) for x in pdf["blob"]]))
                if len(n) > len(total):
                    n, total = total, n
                total[:len(n)] += n
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"id": seen, "n": total[seen]})

    rows = ids.select("blob").mapInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return np.array([r["id"] for r in sorted(rows, key=lambda r: (-r["n"], r["id"]))], np.uint32)


def block(docs: list[tuple[int | None, np.ndarray]], before: int, rank_of: np.ndarray) -> bytes:
    """One block of (doc_id, ids)."""
    ids = np.concatenate([x for _, x in docs])
    control, data = pack_ranks(rank_of[ids])
    has = np.array([d is not None for d, _ in docs], np.uint8).tobytes()
    keys = np.array([d or 0 for d, _ in docs], "<i8").tobytes()
    sizes = np.array([len(x) for _, x in docs], "<u8").tobytes()
    return struct.pack(HEAD, MAGIC, len(docs), len(ids), before, len(data)) + has + keys + sizes + control + data


def write_tokens(ids: DataFrame, root: str, shard_ids: int = SHARD_IDS, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Write stored rows (doc_id, n_tokens, blob) in ascending doc_id order; returns the manifest.

    Null doc_ids come first; rows with one doc_id are ordered by length and content.
    """
    spark = ids.sparkSession
    order = rank_order(ids)
    rank_of = np.zeros(int(order.max()) + 1 if len(order) else 1, np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    fs, path = place(root)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/ranks.bin") as f:
        f.write(order.astype("<u4").tobytes())
    laid = with_range(ids, "doc_id", range_bounds(ids, "doc_id", "n_tokens", shard_ids), "shard")
    totals = laid.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()  # a row a shard
    starts, total = {}, 0
    for r in totals:
        starts[r["shard"]], total = total, total + r["n"]
    shared = spark.sparkContext.broadcast((rank_of, starts))
    rows = laid.repartitionByRange(max(1, len(totals)), "shard").sortWithinPartitions("shard", "doc_id", "n_tokens", "blob")

    def run(batches):
        rank_of, starts = shared.value
        files = RollingFiles(root, ROLL_BYTES, ".rvb")
        shard, held, size, before = None, [], 0, 0

        def flush():
            nonlocal held, size, before
            if held:
                files.write(shard, block(held, before, rank_of), len(held))
            held, size, before = [], 0, before + size

        for pdf in batches:
            keys = pdf["doc_id"].astype("Int64").tolist()
            for s, key, blob in zip(pdf["shard"].tolist(), keys, pdf["blob"]):
                if s != shard:
                    flush()
                    files.end()
                    shard, before = s, starts[s]
                held.append((None if key is pd.NA else key, _grow(bytes(blob))))
                size += len(held[-1][1])
                if size >= block_ids:
                    flush()
            yield from files.manifest()
        flush()
        files.end()
        yield from files.manifest()

    return commit(spark, rows.mapInPandas(run, MANIFEST), root)


def read_tokens(manifest: DataFrame, root: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ids packed as little-endian unsigned 32-bit integers, start counts all before."""
    def parse(stream):
        fs, path = place(root)
        with fs.open_input_stream(f"{path}/ranks.bin") as f:
            order = np.frombuffer(f.read(), "<u4")
        while head := stream.read(struct.calcsize(HEAD)):
            magic, n_docs, n_ids, before, n_data = struct.unpack(HEAD, head)
            if magic != MAGIC:
                raise ValueError("not a token file")
            has = np.frombuffer(stream.read(n_docs), np.uint8)
            keys = pd.array(np.frombuffer(stream.read(8 * n_docs), "<i8"), "Int64")
            keys[has == 0] = pd.NA
            sizes = np.frombuffer(stream.read(8 * n_docs), "<u8").astype(np.int64)
            control = stream.read(-(-n_ids // 4))
            ids = order[unpack_ranks(control, stream.read(n_data), n_ids)].astype("<u4")
            ends = np.cumsum(sizes)
            for at in range(0, n_docs, 500):
                part = slice(at, at + 500)
                yield pd.DataFrame({
                    "doc_id": keys[part], "start": (ends - sizes)[part] + before, "n_tokens": sizes[part],
                    "ids": [ids[b - n:b].tobytes() for b, n in zip(ends[part], sizes[part])]})

    return read_files(manifest, root, "doc_id long, start long, n_tokens long, ids binary", parse)


def round_trip(docs: DataFrame, path: str, root: str | None = None, **options) -> DataFrame:
    """Encode all documents, write the files and read them back.

    Repeated rows are documents of their own; other columns are not read; an empty table writes no file and
    gives no row.
    """
    root = root or work_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(encoded(docs, path), root, **options), root)
