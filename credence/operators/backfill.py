"""Missing text and missing codes."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credence.functions.text import collapse_space
from credence.operators.layout import lookup_join
from credence.operators.profile import text_missing

# fixed values: entities that article text uses, '&amp;' last so that nothing is decoded twice
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}
# one pattern a tag, so that an element ends at its own closing tag
HIDDEN_ELEMENTS = [rf"(?is)<{t}\b.*?</{t}>" for t in ("script", "style", "nav", "header", "footer", "noscript", "title")]
COMMENTS = r"(?s)<!--.*?-->"
TAGS = r"(?s)<[^>]*>"


def page_text(html: Column) -> Column:
    """Readable text of a stored page: hidden elements, comments and tags out, entities decoded."""
    bare = reduce(lambda c, p: F.regexp_replace(c, p, " "), [COMMENTS, *HIDDEN_ELEMENTS, TAGS], html)
    return collapse_space(reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ENTITIES.items(), bare))


def extract_page_text(pages: DataFrame, html: str = "html", out: str = "scraped_text") -> DataFrame:
    return pages.withColumn(out, page_text(F.col(html)))


# fixed values: where a page breaks into blocks, which elements carry no text, and the block classes' limits
BLOCK_BREAK = r"(?i)</?(?:p|div|li|ul|ol|h[1-6]|article|section|nav|header|footer|aside|td|tr|table|blockquote|br|form|main)\b[^>]*>"
NO_TEXT = [COMMENTS, *[rf"(?is)<{t}\b.*?</{t}>" for t in ("script", "style", "noscript", "title")]]
LINKS = r"(?is)<a\b[^>]*>(.*?)</a>"
GOOD_WORDS, SHORT_WORDS, MAX_LINK_DENSITY = 10, 1, 0.25


def _plain(c: Column) -> Column:
    bare = F.regexp_replace(c, TAGS, " ")
    return collapse_space(reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ENTITIES.items(), bare))


def main_text(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """The article body of each page: (key, main_text, n_blocks, n_kept).

    A page is cut into blocks at block-level tags (after comments, scripts, styles and the title are gone).
    Per block: its plain text, words (spaces + 1) and link density (characters of plain text inside links over
    its characters). Classes: good with at least GOOD_WORDS words and density at most MAX_LINK_DENSITY; bad
    with no words or a higher density; short otherwise. A short block is kept only if the nearest classed
    blocks before and after it are both good (the page's ends count as bad): neighbour smoothing by windows
    over the page's blocks. The kept blocks, in order, joined by a space, are the main text ('' if none).
    Null html is an empty page; every input row gets one output row, repeated rows the same one. Everything
    is row-local but the smoothing window and the joining of kept blocks, which a page bounds.
    """
    cleaned = reduce(lambda c, p: F.regexp_replace(c, p, " "), NO_TEXT, F.coalesce(F.col(html), F.lit("")))
    # a page is its id and its html: repeated rows share a result, two htmls under one id keep their own
    ident = F.struct(F.col(key).alias("id"), F.xxhash64(F.coalesce(F.col(html), F.lit(""))).alias("h"))
    blocks = pages.select(ident.alias("_k"), F.posexplode(F.split(cleaned, BLOCK_BREAK)).alias("_i", "_b"))
    text = _plain(F.col("_b"))
    link_chars = F.aggregate(F.regexp_extract_all(F.col("_b"), F.lit(LINKS), 1), F.lit(0),
                             lambda acc, a: acc + F.length(_plain(a)))
    measured = blocks.select("_k", "_i", text.alias("_t"), link_chars.alias("_l")).where(F.col("_t") != "").select(
        "_k", "_i", "_t", (F.size(F.split("_t", " "))).alias("_w"), (F.col("_l") / F.length("_t")).alias("_d"))
    kind = (F.when((F.col("_w") >= GOOD_WORDS) & (F.col("_d") <= MAX_LINK_DENSITY), F.lit("good"))
            .when(F.col("_d") > MAX_LINK_DENSITY, F.lit("bad")).otherwise(F.lit("short")))
    classed = measured.withColumn("_c", kind)
    page = Window.partitionBy("_k").orderBy("_i")
    known = F.when(F.col("_c") != "short", F.col("_c"))
    before = F.last(known, ignorenulls=True).over(page.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(known, ignorenulls=True).over(page.rowsBetween(1, Window.unboundedFollowing))
    keep = (F.col("_c") == "good") | ((F.col("_c") == "short") & (before == "good") & (after == "good"))
    # copies of a repeated row sit next to each other in the window and change no neighbour: the first stays
    kept = (classed.withColumn("_keep", F.coalesce(keep, F.lit(False)))
            .withColumn("_first", F.coalesce(F.lag("_i").over(page) != F.col("_i"), F.lit(True))).where("_first"))
    per_page = kept.groupBy("_k").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.sum(F.col("_keep").cast("long")).alias("n_kept"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_keep"), F.struct("_i", "_t")))),
                                 lambda b: b["_t"]), " ").alias("main_text"))
    return (pages.select(ident.alias("_k")).join(per_page, "_k", "left")
            .select(F.col("_k.id").alias(key), F.coalesce("main_text", F.lit("")).alias("main_text"),
                    F.coalesce("n_blocks", F.lit(0)).cast("long").alias("n_blocks"),
                    F.coalesce("n_kept", F.lit(0)).cast("long").alias("n_kept")))


def backfill_candidates(df: DataFrame) -> DataFrame:
    return df.filter(text_missing())


def backfill_text(df: DataFrame, fetched: DataFrame) -> DataFrame:
    """Take the fetched text where an article has none; several fetches of a link keep the longest.

    Only articles without text are looked up: texts that are there stay where they lie, and only fetches of
    links that are asked for are compared.
    """
    empty = F.col("text").isNull() | (F.col("text") == "")
    missing = df.filter(empty)
    asked = missing.select("url").distinct()
    best = fetched.filter(F.col("scraped_text").isNotNull()).join(asked, "url", "left_semi").groupBy("url").agg(
        F.max(F.struct(F.length("scraped_text"), "scraped_text"))["scraped_text"].alias("_fetched"))
    filled = lookup_join(missing, best, "url").withColumn("text", F.col("_fetched")).drop("_fetched")
    return df.filter(~empty).unionByName(filled)


def inject_predictions(df: DataFrame, predictions: DataFrame, key: str, column: str,
                       predicted: str) -> DataFrame:
    """Replace 'unknown' codes by predictions, matched by key."""
    joined = df.join(predictions.select(key, F.col(predicted).alias("_pred")), key, "left")
    unknown = F.lower(F.col(column)) == "unknown"
    value = F.when(unknown & F.col("_pred").isNotNull(), F.col("_pred")).otherwise(F.col(column))
    return joined.withColumn(column, value).drop("_pred")


def feedback_join(log: DataFrame, labels: DataFrame) -> DataFrame:
    """Logged predictions with the labels that arrived later, matched by the hash of the text."""
    keyed = log.withColumn("text_key", F.md5("text"))
    truth = labels.groupBy(F.md5("text").alias("text_key")).agg(F.max("label").alias("label"))
    return lookup_join(keyed, truth, "text_key").filter(F.col("label").isNotNull())
