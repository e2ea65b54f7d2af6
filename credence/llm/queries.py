"""The operators applied to the driver tables, each to its whole table with production parameters."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.llm import (
    bpe, decontamination, divergence, prefix_trie, language_id, nearest, packing, quality_classifier, quality_rules, simhash, token_files, toxicity, warc,
)
from credence.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_simhash_near_dedup")
def op1(spark, sf):
    return simhash.near_duplicates(table(spark, sf, "documents")).select("doc_id", "fingerprint", "component_id")


@query("op2_bpe")
def op2(spark, sf):
    path = vocabulary("word_bpe_49k.json")
    coded = bpe.decode(bpe.encode(table(spark, sf, "documents"), path), path)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op3_nearest_neighbours")
def op3(spark, sf):
    return nearest.search(table(spark, sf, "embeddings"))


# base 32 of a SHA-1: its 160 bits in fives, by string functions
_BITS = ", ".join(f"'{i:04b}'" for i in range(16))
_B32 = f"""array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  (1 + list_sum(list_transform(range(0, 5), lambda j: (CAST(substr(bits, i * 5 + j + 1, 1) AS BIGINT) << (4 - j)))))::BIGINT, 1)), '')"""


@query("op4_warc", f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS hex,
             row_number() OVER (PARTITION BY body ORDER BY page_id DESC) AS place,
             max(page_id) OVER (PARTITION BY body) AS first FROM p),
b AS (SELECT *, array_to_string(list_transform(string_split(hex, ''), lambda c: [{_BITS}][instr('0123456789abcdef', c)]), '') AS bits FROM h)
SELECT page_id, payload_bytes, {_B32} AS payload_digest,
       CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN place > 1 THEN first END AS refers_to
FROM b""")
def op4(spark, sf):
    return warc.archive(table(spark, sf, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op6_language_id")
def op6(spark, sf):
    return language_id.identify(table(spark, sf, "documents"))


@query("op9_toxicity")
def op9(spark, sf):
    scored = toxicity.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("evidence").alias("n_neighbours"))


@query("op7_token_binary")
def op7(spark, sf):
    back = token_files.round_trip(table(spark, sf, "documents"), vocabulary("byte_bpe_50k.json"))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op5_quality_classifier")
def op5(spark, sf):
    return quality_classifier.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op8_best_fit_packing")
def op8(spark, sf):
    return packing.pack_documents(table(spark, sf, "documents"), vocabulary("byte_bpe_50k.json")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op10_quality_rules")
def op10(spark, sf):
    return quality_rules.quality_rules(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "ratio", "n_chunks", "n_bad_chunks")


@query("pipeline")
def pipeline(spark, sf):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query("op11_decontamination", f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, w[s:s + least(len(w), 10) - 1] AS g
        FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT len(g) AS k FROM win),
grams AS (SELECT doc_id, k, unnest(list_transform(generate_series(1, len(w) - k + 1), lambda p: {{'p': p, 'g': w[p:p + k - 1]}})) AS x
          FROM d, ks WHERE len(w) >= k),
occ AS (SELECT DISTINCT grams.doc_id, x.p AS p, grams.k, win.item_id FROM grams JOIN win ON x.g = win.g),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + k - 1)) AS pos FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS items_sha256
        FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(its.n_items, 0) AS BIGINT) AS n_items, coalesce(its.items_sha256, sha256('')) AS items_sha256,
       coalesce(hit.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)""")
def op11(spark, sf):
    return decontamination.decontaminate(table(spark, sf, "documents"), table(spark, sf, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_TERMS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          "'[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')")


@query("op12_source_divergence", f"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_TERMS} AS t FROM documents),
grp AS (SELECT DISTINCT lang, source FROM d),
kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(t)) AS term FROM d) GROUP BY lang, term HAVING count(*) >= 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
occ AS (SELECT lang, source, term, count(*) AS c FROM (SELECT lang, source, unnest(t) AS term FROM d) GROUP BY ALL),
cnt AS (SELECT g.lang, g.source, k.term, coalesce(o.c, 0) AS c FROM grp g JOIN kept k ON g.lang = k.lang
        LEFT JOIN occ o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
n AS (SELECT lang, source, sum(c) AS n FROM cnt GROUP BY ALL),
pg AS (SELECT cnt.*, 1 + (1000000000::HUGEINT * (cnt.c + 1)) // (n.n + v.v) AS p FROM cnt JOIN n USING (lang, source) JOIN v USING (lang)),
lc AS (SELECT lang, term, sum(c) AS c FROM cnt GROUP BY ALL),
ln AS (SELECT lang, sum(c) AS n FROM lc GROUP BY lang),
pl AS (SELECT lc.lang, lc.term, 1 + (1000000000::HUGEINT * (lc.c + 1)) // (ln.n + v.v) AS q FROM lc JOIN ln USING (lang) JOIN v USING (lang)),
ps AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
       FROM pg a JOIN pg b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT g1.lang, g1.source, g2.source AS item, coalesce(ps.value, 0) AS value FROM grp g1
          JOIN grp g2 ON g1.lang = g2.lang AND g1.source <> g2.source
          LEFT JOIN ps ON ps.lang = g1.lang AND ps.source = g1.source AND ps.item = g2.source),
terms AS (SELECT pg.lang, pg.source, pg.term AS item, (pg.p - pl.q) * (pg.p - pl.q) // pl.q AS value
          FROM pg JOIN pl USING (lang, term) WHERE pg.c > 0 AND pg.p > pl.q),
allr AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM allr)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked
WHERE part = 'pair' OR rank <= 200""")
def op12(spark, sf):
    return divergence.audit(table(spark, sf, "documents"))


@query("op13_prefix_trie")
def op13(spark, sf):
    return prefix_trie.prefix_trie(table(spark, sf, "conversations"))
