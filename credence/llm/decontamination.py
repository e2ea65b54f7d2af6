"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

Words: A-Z lower-cased (nothing else), then runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` (digits, a-z and every
non-ASCII code point). A window is 10 consecutive words of a benchmark item; an item of 1 to 9 words is one
window of all its words; an item without words has none. A document word is hit if it lies inside any occurrence
of any window.

Method. A window occurs in a document only if every one of its words does, so for exact containment the
necessary prefix of its words, ordered by rarity (occurrences in the documents, then the word), is one word: its
rarest. Documents' word positions are joined on that word only (a broadcast hash join against a bounded block of
windows; no shuffle of the documents), the start is fixed by the word's first place in the window (positional
bound), starts before 0 or past the document's end are dropped (length bound), and the survivors are verified
word for word against the window over an item-sized slice. Windows come in blocks of at most WINDOW_BLOCK
distinct windows, so each broadcast has a proven size; every block is joined against all rows.

Defined results: a null or empty text has no words (n_words 0, nothing hit). A benchmark row with a null
item_id or no words gives no window. Equal windows of several items count for each of them. Results depend on
the text only: rows are keyed inside by two hashes of their text (96 bits), so repeated rows, copies under other
ids and null doc_ids all get the result of their text.
An empty benchmark leaves every document clean (items_sha256 of the empty string); an empty documents table
gives no rows. Other columns of `docs` pass untouched; names starting with `_dc_` are used inside.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the contract: the word pattern, the window length, the letters that are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
# Distinct windows joined at once: 200 000 windows of 10 short words stay well under 100 MB broadcast.
WINDOW_BLOCK = 200_000


# The ASCII characters outside words once A-Z are lower-cased: the complement of WORD's ranges.
BREAKS = "".join(chr(c) for lo, hi in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)) for c in range(lo, hi + 1))


def words(text: str | Column) -> Column:
    """The words of a text column, null: none.

    Equal to extracting WORD after lower-casing, but one translate (A-Z down, breaks to spaces) and a split on
    a space: about six times less CPU than the regular expression.
    """
    column = F.col(text) if isinstance(text, str) else text
    spaced = F.translate(F.coalesce(column, F.lit("")), UPPER + BREAKS, LOWER + " " * len(BREAKS))
    return F.array_remove(F.split(spaced, " "), "")


def windows(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, gram): every window of every item, repeats within an item counted once."""
    items = benchmark.where(F.col(key).isNotNull()).select(F.col(key).alias("_dc_item"), words(text).alias("_dc_w"))
    n = F.size("_dc_w")
    return (items.where(n > 0)
            .select("_dc_item", "_dc_w", F.explode(F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0)))).alias("_dc_s"))
            .select("_dc_item", F.slice("_dc_w", F.col("_dc_s") + 1, F.least(n, F.lit(WINDOW))).alias("_dc_gram"))
            .distinct())


def _positions(docs: DataFrame) -> DataFrame:
    return docs.select("_dc_h", "_dc_m", "_dc_w", F.size("_dc_w").alias("_dc_n"),
                       F.posexplode("_dc_w").alias("_dc_p", "_dc_word"))


def _prefixes(docs: DataFrame, block: DataFrame) -> DataFrame:
    """Each window of the block with its rarest word and that word's first place in it."""
    placed = block.select("_dc_gram", F.posexplode("_dc_gram").alias("_dc_j", "_dc_word"))
    tokens = placed.select("_dc_word").distinct()
    counts = (_positions(docs).select("_dc_word").join(F.broadcast(tokens), "_dc_word")
              .groupBy("_dc_word").agg(F.count(F.lit(1)).alias("_dc_c")))
    ranked = placed.join(counts, "_dc_word", "left").fillna(0, ["_dc_c"])
    best = ranked.groupBy("_dc_gram").agg(F.min(F.struct("_dc_c", "_dc_word", "_dc_j")).alias("_dc_b"))
    return best.select("_dc_gram", F.col("_dc_b._dc_word").alias("_dc_word"), F.col("_dc_b._dc_j").alias("_dc_j"),
                       F.size("_dc_gram").alias("_dc_k"))


def occurrences(docs: DataFrame, grams: DataFrame, n_windows: int) -> DataFrame:
    """(_dc_h, _dc_m, _dc_s, _dc_k, _dc_gram): verified occurrences, block by block of distinct windows."""
    blocks = max(1, -(-n_windows // WINDOW_BLOCK))
    keyed = grams.withColumn("_dc_block", F.pmod(F.xxhash64("_dc_gram"), F.lit(blocks)))
    found = None
    for b in range(blocks):
        prefix = _prefixes(docs, keyed.where(F.col("_dc_block") == b).drop("_dc_block"))
        start = F.col("_dc_p") - F.col("_dc_j")
        hit = (_positions(docs).join(F.broadcast(prefix), "_dc_word")
               .where((start >= 0) & (start + F.col("_dc_k") <= F.col("_dc_n")))
               .where(F.slice("_dc_w", start + 1, F.col("_dc_k")) == F.col("_dc_gram"))
               .select("_dc_h", "_dc_m", start.alias("_dc_s"), "_dc_k", "_dc_gram"))
        found = hit if found is None else found.unionByName(hit)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
                  item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """Every row of `docs` with n_words, n_hit, n_items, items_sha256 and contaminated added."""
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.withColumn("_dc_h", F.xxhash64(body)).withColumn("_dc_m", F.hash(body))
    texts = keyed.select("_dc_h", "_dc_m", words(text).alias("_dc_w"))
    item_windows = windows(benchmark, item_key, item_text)
    grams = item_windows.select("_dc_gram").distinct()
    n_windows = grams.count()
    if n_windows == 0:
        stats = texts.select("_dc_h", "_dc_m", F.lit(0).cast("long").alias("_dc_hit"),
                             F.lit(0).cast("long").alias("_dc_items"), F.lit("").alias("_dc_sha")).limit(0)
    else:
        occ = occurrences(texts, grams, n_windows)
        hits = (occ.select("_dc_h", "_dc_m", F.explode(F.sequence("_dc_s", F.col("_dc_s") + F.col("_dc_k") - 1)).alias("_dc_pos"))
                .distinct().groupBy("_dc_h", "_dc_m").agg(F.count(F.lit(1)).alias("_dc_hit")))
        items = (occ.select("_dc_h", "_dc_m", "_dc_gram").distinct().join(item_windows, "_dc_gram")
                 .select("_dc_h", "_dc_m", "_dc_item").distinct()
                 .groupBy("_dc_h", "_dc_m").agg(
                     F.count(F.lit(1)).alias("_dc_items"),
                     F.sha2(F.array_join(F.array_sort(F.collect_list(F.col("_dc_item").cast("string"))), ","), 256)
                     .alias("_dc_sha")))
        stats = hits.join(items, ["_dc_h", "_dc_m"], "full")
    stats = stats.select(F.col("_dc_h").alias("_dc_h2"), F.col("_dc_m").alias("_dc_m2"), "_dc_hit", "_dc_items", "_dc_sha")
    sized = keyed.withColumn("_dc_n", F.size(words(text)).cast("long"))
    back = sized.join(stats, (sized["_dc_h"] == stats["_dc_h2"]) & (sized["_dc_m"] == stats["_dc_m2"]), "left")
    clashing = {"n_words", "n_hit", "n_items", "items_sha256", "contaminated"}
    n_hit = F.coalesce("_dc_hit", F.lit(0)).cast("long")
    return back.select(*[sized[c] for c in docs.columns if c not in clashing],
                       F.col("_dc_n").alias("n_words"), n_hit.alias("n_hit"),
                       F.coalesce("_dc_items", F.lit(0)).cast("long").alias("n_items"),
                       F.coalesce("_dc_sha", F.sha2(F.lit(""), 256)).alias("items_sha256"),
                       (n_hit > 0).alias("contaminated"))
