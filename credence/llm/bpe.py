"""BPE encoding and decoding of whole texts; long ones by tree concatenation.

A text of up to LEAF characters is encoded in its row. A longer one, split at no place that could be trusted,
is cut into halves, and those again, down to leaves; leaves are rows, so tasks encode them in parallel.
Then neighbours are joined pair by pair up the tree: a window around the join is encoded again and grows
until it agrees with both sides on a token, left and right, of the same characters. From a token on which
two encodings agree, both go on alike: whether two neighbouring tokens may stand together depends on these two only,
so left tokens, window tokens and right tokens form the encoding of the whole. If a leaf's kept edges do
not suffice, its document is encoded whole.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm.common import map_texts, small_batches, text_steps
from credence.llm.encoding import encoder

LEAF = 16_384
FIRST = 8        # tokens on either side in the first window
EDGE = 512       # tokens of a leaf's edges kept with their places
KIND = "word"


def spans(library, text: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, places): places are (start, end) characters of each token."""
    e = library.encode(text, add_special_tokens=False)
    return np.array(e.ids, np.int64), np.array(e.offsets, np.int64).reshape(-1, 2)


def _clean(at: np.ndarray) -> np.ndarray:
    """Tokens that share no character with a neighbour (byte tokens of one character do)."""
    ok = at[:, 1] > at[:, 0]
    ok[1:] &= at[1:, 0] >= at[:-1, 1]
    ok[:-1] &= at[:-1, 1] <= at[1:, 0]
    return ok


def _common(a_ids, a_at, b_ids, b_at) -> list[tuple[int, int]]:
    """Pairs (i, j) of clean tokens with equal id and place, in order."""
    where = {(s, e, t): j for j, (ok, (s, e), t) in enumerate(zip(_clean(b_at).tolist(), b_at.tolist(), b_ids.tolist())) if ok}
    return [(i, where[s, e, t]) for i, (ok, (s, e), t) in enumerate(zip(_clean(a_at).tolist(), a_at.tolist(), a_ids.tolist()))
            if ok and (s, e, t) in where]


def join(library, text: str, left, right):
    """Join the encodings of two neighbouring stretches; places count from the start of `text`, which covers
    the tokens given. Returns (ids, places), or None if no window inside `text` agrees with both."""
    (l_ids, l_at), (r_ids, r_at) = left, right
    width = FIRST
    while True:
        whole_left, whole_right = width >= len(l_ids), width >= len(r_ids)
        a = 0 if whole_left else int(l_at[-width, 0])
        b = len(text) if whole_right else int(r_at[width - 1, 1])
        w_ids, w_at = spans(library, text[a:b])
        w_at = w_at + a
        i = j = None
        if whole_left:
            i, from_w = 0, 0
        else:
            found = _common(l_ids[-width:], l_at[-width:], w_ids, w_at)
            if found:
                k, from_w = found[0]
                i = len(l_ids) - width + k
        if whole_right:
            j, to_w = len(r_ids), len(w_ids)
        else:
            found = [p for p in _common(r_ids[:width], r_at[:width], w_ids, w_at)]
            if found:
                j, to_w = found[-1]
        if i is not None and j is not None and from_w <= to_w:
            return (np.concatenate([l_ids[:i], w_ids[from_w:to_w], r_ids[j:]]),
                    np.concatenate([l_at[:i], w_at[from_w:to_w], r_at[j:]]))
        if whole_left and whole_right:
            return w_ids, w_at
        width *= 2


def tree_encode(library, text: str, leaf: int = LEAF) -> np.ndarray:
    """Ids of one text by halves, in one place: the tree without Spark."""
    def half(a: int, b: int):
        if b - a <= leaf:
            ids, at = spans(library, text[a:b])
            return ids, at + a
        m = (a + b) // 2
        left, right = half(a, m), half(m, b)
        ids, at = join(library, text[a:b], (left[0], left[1] - a), (right[0], right[1] - a))
        return ids, at + a

    return half(0, len(text))[0]


def _pack(ids) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


LEAF_TYPE = "ids binary, text string, head_end int, tail_start int, head_at binary, tail_at binary"


def _leaf(library, text: str) -> dict:
    """A leaf's ids and text, and the places of the tokens of its two edges."""
    ids, at = spans(library, text)
    n = len(ids)
    start = int(at[n - EDGE, 0]) if n > EDGE else 0
    return {"ids": _pack(ids), "text": text, "head_end": int(at[EDGE - 1, 1]) if n > EDGE else len(text),
            "tail_start": start, "head_at": _pack(at[:EDGE].ravel()), "tail_at": _pack(at[-EDGE:].ravel() - start)}


def _places(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u4").astype(np.int64).reshape(-1, 2)


def _tree(library, leaves: list[dict]) -> bytes | None:
    """Join the leaves of a document pair by pair; None if an edge is too short for both sides to agree."""
    # a stretch: ids, text and places of its first tokens, text and places of its last tokens
    rows = [(np.frombuffer(x["ids"], "<u4").astype(np.int64), x["text"][:x["head_end"]], _places(x["head_at"]),
             x["text"][x["tail_start"]:], _places(x["tail_at"])) for x in leaves]
    while len(rows) > 1:
        nxt = []
        for k in range(0, len(rows) - 1, 2):
            (li, lh, lha, lt, lta), (ri, rh, rha, rt, rta) = rows[k], rows[k + 1]
            n, m = len(lta), len(rha)
            mid, at = join(library, lt + rh, (li[len(li) - n:], lta), (ri[:m], rha + len(lt)))
            whole_l, whole_r = n == len(li), m == len(ri)
            # an edge that is not its whole stretch must keep its outermost token, or the window was too small
            if not whole_l and (not len(mid) or mid[0] != li[len(li) - n] or (at[0] != lta[0]).any()):
                return None
            if not whole_r and (not len(mid) or mid[-1] != ri[m - 1] or (at[-1] != rha[-1] + len(lt)).any()):
                return None
            nxt.append((np.concatenate([li[:len(li) - n], mid, ri[m:]]),
                        *((lt + rh, at) if whole_l else (lh, lha)),
                        *((lt + rh, at) if whole_r else (rt, rta))))
        rows = nxt + rows[len(rows) - len(rows) % 2:]
    return _pack(rows[0][0])


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", leaf: int = LEAF, kind: str = KIND) -> DataFrame:
    """(doc_id, ids): ids packed as little-endian unsigned 32-bit integers.

    A null or empty text has no ids. Repeated rows and null keys give a row each; other columns are not read.
    """
    small_batches(docs.sparkSession)
    frame = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    doc_type = frame.schema["doc_id"].dataType.simpleString()
    n = F.length("text")
    short = map_texts(frame.filter(F.col("text").isNull() | (n <= leaf)), ["doc_id"], f"doc_id {doc_type}, ids binary",
                      lambda texts: {"ids": encoder(path, kind).encode(texts)})
    # halves of halves: a power of two of equal leaves, none over `leaf` characters
    many = F.pow(F.lit(2.0), F.ceil(F.log2(n / F.lit(float(leaf)))))
    cut = (frame.filter(n > leaf).withColumn("_row", F.monotonically_increasing_id()).withColumn("_n", many.cast("int"))
           .withColumn("_leaf", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
           .withColumns({"_from": F.floor(n * F.col("_leaf") / F.col("_n")).cast("int"),
                         "_to": F.floor(n * (F.col("_leaf") + 1) / F.col("_n")).cast("int")})
           .select("doc_id", "_row", "_leaf", F.expr("substring(text, _from + 1, _to - _from)").alias("text"))
           .repartition(F.col("_row"), F.col("_leaf")))

    def leaves(batches):
        library = encoder(path, kind).library
        for rows, texts in text_steps(batches):
            made = pd.DataFrame([_leaf(library, t) for t in texts])
            yield pd.concat([rows[["doc_id", "_row", "_leaf"]].reset_index(drop=True), made], axis=1)

    parts = cut.mapInPandas(leaves, f"doc_id {doc_type}, _row long, _leaf int, {LEAF_TYPE}")
    fields = ["_leaf", *[x.split()[0] for x in LEAF_TYPE.split(", ")]]
    whole = parts.groupBy("_row").agg(F.first("doc_id").alias("doc_id"),
                                      F.sort_array(F.collect_list(F.struct(*fields))).alias("leaves"))

    def trees(batches):
        coder = encoder(path, kind)
        for pdf in batches:
            out = []
            for group in pdf["leaves"]:
                group = [x if isinstance(x, dict) else x.asDict() for x in group]
                ids = _tree(coder.library, group)
                out.append(coder.encode(["".join(x["text"] for x in group)])[0] if ids is None else ids)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": out})

    return short.unionByName(whole.mapInPandas(trees, f"doc_id {doc_type}, ids binary"))


def decode(encoded: DataFrame, path: str, kind: str = KIND) -> DataFrame:
    """Add `decoded`, the library's text of the packed `ids`, special tokens kept."""
    def run(batches):
        coder = encoder(path, kind)
        for pdf in batches:
            yield pdf.assign(decoded=coder.decode([bytes(x) for x in pdf["ids"]]))

    small_batches(encoded.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInPandas(run, f"{schema}, decoded string")
