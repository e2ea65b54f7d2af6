"""Decontamination, source divergence and the conversation prefix trie against brute force, on odd tables."""
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

from credence.llm import decontamination, divergence, prefix_trie
from credence.llm.divergence import gallop, merge_pair

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_decontamination(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    wins = defaultdict(set)
    for item_id, text in items:
        w = word.findall((text or "").translate(LOW))
        if item_id is None or not w:
            continue
        for s in range(max(len(w) - 9, 1)):
            wins[tuple(w[s:s + min(len(w), 10)])].add(item_id)
    out = []
    for doc_id, text in docs:
        w = word.findall((text or "").translate(LOW))
        hit, found = set(), set()
        for g, ids in wins.items():
            k = len(g)
            for s in range(len(w) - k + 1):
                if tuple(w[s:s + k]) == g:
                    hit.update(range(s, s + k))
                    found |= ids
        joined = ",".join(sorted(str(i) for i in found))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(joined.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


PASSAGE = "Alpha beta GAMMA delta epsilon zeta eta theta iota kappa lambda mu"
ITEMS = [(1, PASSAGE), (2, "Short ITEM here"), (None, "beta gamma delta"), (3, ""), (4, None), (5, "Short item here")]
DOCS = [
    (1, "intro " + PASSAGE + " outro"), (2, None), (3, ""), (4, "short item here and " + "filler " * 3000 + PASSAGE[:40]),
    (4, "short item here and " + "filler " * 3000 + PASSAGE[:40]), (None, "Short item HERE"), (5, "alpha beta gamma"),
    (6, "x " * 5 + " ".join(PASSAGE.split()[2:]) + " " + PASSAGE), (7, "ÉCOLE été " + PASSAGE.upper()),
]


def _docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 9) for r in rows], "doc_id long, text string, n_hit string, _dc_h long")


def test_decontamination_matches_brute_force(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontamination.decontaminate(_docs(spark, DOCS), items).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted(map(tuple, got), key=repr) == brute_decontamination(DOCS, ITEMS)
    assert {r.doc_id for r in got if r.contaminated} == {None, 1, 4, 6, 7}


def test_decontamination_empty_tables(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    got = decontamination.decontaminate(_docs(spark, DOCS), items).collect()
    assert len(got) == len(DOCS) and not any(r.contaminated for r in got)
    assert {r.items_sha256 for r in got} == {hashlib.sha256(b"").hexdigest()}
    none = decontamination.decontaminate(_docs(spark, []), spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert none.count() == 0


def brute_divergence(docs):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    rows = [(lang or "", src or "", term.findall((text or "").translate(LOW))) for text, lang, src in docs]
    langs = defaultdict(set)
    for lang, src, _ in rows:
        langs[lang].add(src)
    out = []
    for lang, sources in langs.items():
        df = Counter(t for l, _, ts in rows if l == lang for t in set(ts))
        kept = sorted(t for t, n in df.items() if n >= 3)
        v = len(kept)
        cnt = {s: Counter(t for l, s2, ts in rows if l == lang and s2 == s for t in ts) for s in sources}
        whole = Counter()
        for s in sources:
            whole.update(cnt[s])

        def prices(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10 ** 9 * (c[t] + 1) // (n + v) for t in kept}
        p = {s: prices(cnt[s]) for s in sources}
        q = prices(whole)
        for s in sources:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if cnt[s][t] > 0 and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                for rank, (item, value) in enumerate(items, 1):
                    if part == "pair" or rank <= 200:
                        out.append((lang, s, part, item, value, rank))
    return sorted(out, key=repr)


@pytest.mark.parametrize("tile,block", [(64, 4096), (1, 2)])
def test_divergence_matches_brute_force(spark, monkeypatch, tile, block):
    monkeypatch.setattr(divergence, "SOURCES_PER_TILE", tile)
    monkeypatch.setattr(divergence, "BLOCK_TERMS", block)
    base = ["Der Hund und die Katze", "der hund schläft", "Die Katze und der Hund", "Hund Hund Hund Katze",
            "und die", "Ölung und Hund"]
    docs = ([(t, "de", f"s{i % 3}") for i, t in enumerate(base * 3)]
            + [(None, "de", "s9"), ("Hund", None, None), ("hund hund", None, "x"), ("one two", "en", "solo"),
               ("the cat and the dog", "fr", "a"), ("the cat", "fr", "b"), ("the dog", "fr", "a"), ("dog", "fr", "b")]
            + [("Der Hund und die Katze", "de", "s0")] * 2)
    frame = spark.createDataFrame([(*d, 1) for d in docs], "text string, lang string, source string, rank int")
    got = sorted(map(tuple, divergence.audit(frame).collect()), key=repr)
    assert got == brute_divergence(docs)
    assert any(r[0] == "" for r in got) and not any(r[0] == "en" and r[2] == "pair" for r in got)
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


@pytest.mark.parametrize("ratio", [8, 10 ** 9, 1])
def test_gallop_and_merge(monkeypatch, ratio):
    import numpy as np
    monkeypatch.setattr(divergence, "GALLOP_RATIO", ratio)
    a, b = np.array([2, 5, 9, 40]), np.array([1, 2, 3, 5, 8, 9, 10, 39, 41, 50])
    assert [x.tolist() for x in gallop(a, b)] == [[0, 1, 2], [1, 3, 5]]
    assert [x.tolist() for x in gallop(np.array([], dtype=np.int64), b)] == [[], []]
    ab, ba = merge_pair(np.array([1, 3]), np.array([10, 30]), np.array([3, 4]), np.array([20, 5]), 2, 3)
    # terms 1, 3, 4 held; f - f(p0, p0') both ways
    f = lambda p, q: (p - q) ** 2 // q
    assert ab == f(10, 3) + f(30, 20) + f(2, 5) - 3 * f(2, 3)
    assert ba == f(3, 10) + f(20, 30) + f(5, 2) - 3 * f(3, 2)


def brute_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn, role or "", text or ""))
    orig = {c: [(r, t) for _, r, t in sorted(ts, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))]
            for c, ts in convs.items()}
    rebuilt = {}
    for c in orig:
        h = zlib.crc32(str(c).encode()) % 9
        b = c - int(__import__("math").fmod(c, 5))
        rebuilt[c] = orig.get(b, [])[:h] + orig[c][h:]
    nodes = defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            nodes[tuple(seq[:d])].append(c)
    kids = defaultdict(set)
    for k in nodes:
        if k:
            kids[k[:-1]].add(k)
    leaves, saved = {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] = (0 if kids[k] else 1) + sum(leaves[x] for x in kids[k])
        saved[k] = (len(nodes[k]) - 1) * (len(k[-1][1].encode()) if k else 0) + sum(saved[x] for x in kids[k])
    out = []
    for k, mem in nodes.items():
        ends = ",".join(map(str, sorted(c for c in mem if len(rebuilt[c]) == len(k))))
        out.append((min(mem), len(k), min(nodes[k[:-1]]) if k else None, len(mem), len(kids[k]), leaves[k], saved[k],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversation_rows():
    hello = [("user", "Hello there"), ("assistant", "Hi! How can I help?")]
    rows = []
    for c in range(0, 40):
        for t, (r, x) in enumerate(hello + [("user", f"question {c % 4}"), ("assistant", "x" * (c % 3))]):
            rows.append((c, t, r, x))
    rows += [(40, None, None, None), (40, None, "user", "same"), (40, 1, "user", "same"), (40, 1, "user", "same"),
             (41, 0, "user", "ça va ☃"), (None, 0, "user", "lost"), (47, 3, "user", "long " * 5000),
             (-3, 0, "user", "negative"), (100, 0, "user", "Hello there"), (105, 0, None, "")]
    return rows


@pytest.mark.parametrize("shard", [prefix_trie.SHARD_SEQS, 2])
def test_prefix_trie_matches_brute_force(spark, shard):
    rows = conversation_rows()
    frame = spark.createDataFrame([(*r, 1.0) for r in rows], "conv_id long, turn long, role string, text string, depth double")
    got = sorted(map(tuple, prefix_trie.prefix_trie(frame, shard).collect()), key=repr)
    assert got == brute_trie(rows)


def test_double_array_and_empty(spark):
    base, check, order = prefix_trie.double_array([[1], [1, 2], [1, 3], [2, 2, 2]])
    assert len(order) == 7 and len(set(order)) == 7
    for t in order[1:]:
        assert base[check[t]] < t
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(empty).count() == 0
    one = spark.createDataFrame([(7, None, None, None)], "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, prefix_trie.prefix_trie(one).collect()), key=repr) == brute_trie([(7, None, None, None)])


def test_divergence_counts_terms_in_one_pass(monkeypatch):
    """Occurrences and documents leave a task as sums, however often its memory fills; empty texts leave nothing."""
    import pyarrow as pa

    from credence.llm import divergence as DV
    rows = [("en", "a", "x y x"), ("en", "b", " x  é "), ("de", "a", ""), ("en", "a", "x")]
    batch = pa.RecordBatch.from_pylist([dict(zip(("lang", "source", "_t"), r)) for r in rows])
    for entries in (DV.ENTRIES, 1):
        monkeypatch.setattr(DV, "ENTRIES", entries)
        got = {}
        for out in DV.count_terms(iter([batch, batch.slice(0, 0)])):
            for r in out.to_pylist():
                c, d = got.get((r["lang"], r["source"], r["term"]), (0, 0))
                got[r["lang"], r["source"], r["term"]] = (c + r["c"], d + r["d"])
        assert got == {("en", "a", "x"): (3, 2), ("en", "a", "y"): (1, 1), ("en", "b", "x"): (1, 1), ("en", "b", "é"): (1, 1)}
    assert list(DV.count_terms(iter([]))) == []
