"""Bindings of text noise, arm values and prompts."""
from __future__ import annotations

from pyspark.sql import functions as F

from catalog import sqlfn as S
from catalog.evaluation import AP
from catalog.fixtures import CANON, canonical, hash32_sql, table, uniform_sql
from catalog.registry import query, quoted, r6, r6s
from credence import constants as K
from credence.functions.hashing import uniform
from credence.operators import augment as A
from credence.operators import metrics as M
from credence.operators import prompts as P
from credence.operators.layout import cut_lineage

M32 = 4294967296


def mix_sql(seed: str, pos: str, stream: int = 0) -> str:
    x = f"(({seed} + {pos} * 2654435 + {stream * 40503}) % {M32})"
    x = f"(({x} * 1103515245 + 12345) % {M32})"
    x = f"xor({x}, {x} >> 15)"
    x = f"(({x} * 1664525 + 1013904223) % {M32})"
    return f"xor({x}, {x} >> 13)"


def u_sql(seed: str, pos: str, stream: int = 0) -> str:
    return f"({mix_sql(seed, pos, stream)} / {M32}::DOUBLE)"


def d(x) -> str:
    return f"{x!r}::DOUBLE" if isinstance(x, float) else x


def typos_sql(c, seed, p=0.03):
    u = u_sql(seed, "(i - 1)")
    abc = f"substr('{K.TYPO_ALPHABET}', CAST({mix_sql(seed, '(i - 1)', 1)} % {len(K.TYPO_ALPHABET)} AS INTEGER) + 1, 1)"
    return (f"array_to_string(list_transform(string_split({c}, ''), lambda ch, i: CASE WHEN {u} < {d(p)} / 3 THEN '' "
            f"WHEN {u} < 2 * {d(p)} / 3 THEN ch || ch WHEN {u} < {d(p)} THEN {abc} ELSE ch END), '')")


def burst_sql(c, seed, p=0.2):
    return (f"array_to_string(list_transform(regexp_extract_all({c}, '(?s)\\.\\.\\.|!|\\?|[^!?.]+|\\.'), lambda q, i: CASE WHEN q IN ('!', '?', '...') "
            f"AND {u_sql(seed, '(i - 1)')} < {d(p)} THEN repeat(q, CAST({mix_sql(seed, '(i - 1)', 1)} % 3 AS INTEGER) + 1) ELSE q END), '')")


def emoji_sql(c, seed, p=0.2):
    pick = lambda pos: f"[{quoted(K.EMOJIS)}][CAST({mix_sql(seed, pos, 1)} % 8 AS INTEGER) + 1]"
    return (f"CASE WHEN {u_sql(seed, '0')} < {d(p)} THEN {pick('0')} || ' ' || {c} WHEN {u_sql(seed, '1')} < {d(p)} "
            f"THEN {c} || ' ' || {pick('1')} ELSE {c} END")


def homoglyph_sql(c, seed, p=0.05):
    return (f"array_to_string(list_transform(string_split({c}, ''), lambda ch, i: CASE WHEN {u_sql(seed, '(i - 1)')} < {d(p)} "
            f"THEN translate(ch, '{''.join(K.HOMOGLYPHS)}', '{''.join(K.HOMOGLYPHS.values())}') ELSE ch END), '')")


def nikud_sql(c, seed, p=0.05):
    bare = f"regexp_replace({c}, '[\\x{{0591}}-\\x{{05C7}}]', '', 'g')"
    return (f"array_to_string(list_transform(string_split({bare}, ''), lambda ch, i: CASE WHEN regexp_full_match(ch, '{S.WS}') "
            f"AND {u_sql(seed, '(i - 1)')} < {d(p)} / 2 THEN ch || ch ELSE ch END), '')")


NOISE_SQL = {"keyboard_typos": typos_sql, "punct_burst": burst_sql, "emoji": emoji_sql,
             "homoglyphs": homoglyph_sql, "nikud_space": nikud_sql}
SEED = hash32_sql("doc_id", "42-text")

for _arm, _sql in NOISE_SQL.items():
    query(f"aug_{_arm}", f"WITH {CANON}, s AS (SELECT doc_id, text, {SEED} AS seed FROM canon) SELECT doc_id, {_sql('text', 'seed')} AS text FROM s")(
        lambda spark, sf_dir, arm=_arm: A.augment(canonical(spark, sf_dir), "doc_id", "text", arm, 1.0).select("doc_id", "text"))


@query("augment_fraction", f"""WITH {CANON}, s AS (SELECT doc_id, text, {SEED} AS seed FROM canon)
    SELECT doc_id, CASE WHEN {uniform_sql('doc_id', '42-row')} < 0.7::DOUBLE THEN {homoglyph_sql('text', 'seed')} ELSE text END AS text FROM s""")
def augment_fraction(spark, sf_dir):
    return A.augment(canonical(spark, sf_dir), "doc_id", "text", "homoglyphs").select("doc_id", "text")


@query("augment_mixed", f"""WITH {CANON}, s AS (SELECT doc_id, text, {SEED} AS seed, {hash32_sql('doc_id', '42-arm')} % 3 AS arm FROM canon)
    SELECT doc_id, CASE WHEN NOT {uniform_sql('doc_id', '42-row')} < 0.7::DOUBLE THEN text WHEN arm = 0 THEN {typos_sql('text', 'seed')}
      WHEN arm = 1 THEN {burst_sql('text', 'seed')} ELSE {nikud_sql('text', 'seed')} END AS text FROM s""")
def augment_mixed(spark, sf_dir):
    return A.augment(canonical(spark, sf_dir), "doc_id", "text").select("doc_id", "text")


# The recursion itself, step by step in SQL: v <- 0.8 v + 0.2 r in log order.
ARM_VALUES = f"""arms AS (SELECT event_type AS arm, list_reduce(list_prepend(0::DOUBLE, list(value ORDER BY ts, event_id)), lambda v, r: 0.8::DOUBLE * v + 0.2::DOUBLE * r) AS v,
    count(*) AS n FROM events GROUP BY event_type)"""


def rewards(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("arm"), "event_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))


@query("arm_values", f"WITH {ARM_VALUES} SELECT arm, {r6s('v')} AS value, n FROM arms")
def arm_values(spark, sf_dir):
    return A.arm_values(rewards(spark, sf_dir), "arm", "at", "event_id", "value").withColumn("value", r6("value"))


@query("choose_arm")
def choose_arm(spark, sf_dir):
    values = A.arm_values(rewards(spark, sf_dir), "arm", "at", "event_id", "value")
    return A.choose_arm(values, "arm", step=3, eps=A.epsilon(3, 30))


GRID = {"keyboard_typos": [0.03, 0.2], "emoji": [0.2, 0.8], "punct_burst": [0.5]}
_CASES = " UNION ALL ".join(
    ["SELECT doc_id, label, text, 'clean' AS noise, 0::DOUBLE AS intensity FROM s"]
    + [f"SELECT doc_id, label, {NOISE_SQL[a]('text', 'seed', p)}, '{a}', {p}::DOUBLE FROM s" for a, ps in GRID.items() for p in ps])


@query("augmentation_sweep", f"""WITH {CANON}, s AS (SELECT doc_id, label, text, {SEED} AS seed FROM canon WHERE label IS NOT NULL), g AS ({_CASES}),
    p AS (SELECT noise, intensity, label, {uniform_sql('md5(text)')} * 0.6::DOUBLE + (1 - label) * 0.4::DOUBLE AS p_fake FROM g),
    pts AS (SELECT noise, intensity, p_fake AS score, count(*) FILTER (label = 0) AS pos, count(*) FILTER (label = 1) AS neg FROM p GROUP BY ALL),
    cum AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn FROM pts WINDOW w AS (PARTITION BY noise, intensity ORDER BY score DESC))
    SELECT noise, intensity, {r6s(AP)} AS pr_auc FROM cum GROUP BY ALL""")
def augmentation_sweep(spark, sf_dir):
    labelled = canonical(spark, sf_dir).filter("label IS NOT NULL").select("doc_id", "label", "text")
    grid = A.noise_grid(labelled, "doc_id", "text", GRID)
    scored = grid.withColumn("p_fake", uniform(F.md5("text")) * 0.6 + (1 - F.col("label")) * 0.4)
    keys = ["noise", "intensity"]
    # the curve reads its counts several times: texts are noised and scored once
    counts = cut_lineage(M.score_counts(scored, "p_fake", "label", keys))
    return M.average_precision(M.cumulated(counts, keys), keys).withColumn("pr_auc", r6("pr_auc"))


HEAD = "'" + K.PROMPT_INSTRUCTION + "' || chr(10)"


@query("label_prompts", f"""WITH {CANON} SELECT doc_id, {HEAD} || 'Text: ' || text || chr(10) || 'Label:' AS prompt,
    {HEAD} || 'Title: ' || coalesce(title, '') || chr(10) || 'Text: ' || text || chr(10) || 'Label:' AS titled FROM canon""")
def label_prompts(spark, sf_dir):
    df = P.label_prompts(canonical(spark, sf_dir))
    return df.select("doc_id", "prompt", P.label_prompt(F.col("text"), F.col("title")).alias("titled"))


@query("sft_examples", f"""WITH {CANON} SELECT doc_id, CASE label WHEN 0 THEN 1 ELSE 0 END AS target, {HEAD} || 'Text: ' || text || chr(10) || 'Label:' || ' '
    || CASE label WHEN 0 THEN '<FAKE>' ELSE '<REAL>' END AS example FROM canon WHERE label IS NOT NULL""")
def sft_examples(spark, sf_dir):
    return P.sft_examples(canonical(spark, sf_dir).filter("label IS NOT NULL")).select("doc_id", "target", "example")


@query("conversation_prompts", f"SELECT conv_id, turn, {HEAD} || 'Text: ' || text || chr(10) || 'Label:' AS prompt FROM conversations "
                               f"UNION ALL SELECT item_id, CAST(NULL AS BIGINT), {HEAD} || 'Text: ' || text || chr(10) || 'Label:' FROM benchmark")
def conversation_prompts(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    items = table(spark, sf_dir, "benchmark").selectExpr("item_id AS conv_id", "CAST(NULL AS BIGINT) AS turn", "text")
    return P.label_prompts(turns.unionByName(items)).drop("text")


_REQ = "'" + K.BACKGROUND_REQUEST.format(max_chars=800).replace("'", "''") + "\"\"\"'"


@query("context_request_prompts", f"""WITH {CANON}, bg AS (SELECT md5(text) AS k, min('Background ' || title) AS b FROM canon WHERE doc_id % 4 = 0 AND title IS NOT NULL GROUP BY 1)
    SELECT doc_id, {_REQ} || substr(text, 1, 4000) || '\"\"\"' AS request,
      text || ' || ' || substr(coalesce(CASE WHEN length(b) > 800 THEN rtrim(substr(b, 1, 800)) || '…' ELSE b END, ''), 1, 800) AS with_background
    FROM canon LEFT JOIN bg ON md5(text) = k""")
def context_request_prompts(spark, sf_dir):
    df = canonical(spark, sf_dir).select("doc_id", "title", "text").withColumn("request", P.context_request(F.col("text")))
    background = canonical(spark, sf_dir).filter("doc_id % 4 = 0 AND title IS NOT NULL").selectExpr(
        "text", "concat('Background ', title) AS background")
    return P.add_background(df, background).selectExpr("doc_id", "request", "text AS with_background")
