"""The ten corpus operators and the pipeline against brute force, and on odd tables."""
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from credence.llm import (
    bpe, encoding, language_id, nearest, packing, quality_classifier, quality_rules, queries, simhash, token_files,
    toxicity, warc,
)
from credence.llm.common import range_bounds, table, with_range

SF = "/root/testdata/sf0.001"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, score double, _text string, fp long"
LONG = "Das ist ein langer Text ohne Ende " * 700 + "x" * 20_000


def odd_documents(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing extra columns."""
    words = [f"wort{i}" for i in range(60)]
    rows = [
        (1, None, None, None, None), (2, "", "en", "s", 0), (3, "   \n\t ", "en", None, 6), (4, LONG, "de", "s", len(LONG)),
        (5, " ".join(words), "de", "s", 1), (5, " ".join(words), "de", "s", 1), (6, " ".join(words), None, "s", 1),
        (None, "The one with no id of its own but words enough", "en", "s", 3), (7, "日本語 text é <|endoftext|> ́x", "fr", "s", 3),
        (8, "12345 !!! ???", "en", "s", 3), (9, "a b c", "en", "s", 3), (5, "another text under a used id", "en", "s", 2),
    ]
    return spark.createDataFrame([(*r, "clash", 1.5, "clash", 7) for r in rows], DOCS)


def empty_documents(spark):
    return spark.createDataFrame([], DOCS)


def labels(spark, *rows):
    return spark.createDataFrame(list(rows) or [(None, None, None)], "doc_id long, quality int, toxic int")


def documents(spark):
    return table(spark, SF, "documents")


# ---- quality rules

def brute_rules(text):
    text = text or ""
    words, word = [], ""
    for ch in text + " ":
        if ch in " \t\n\x0b\x0c\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += ch
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    counts, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            hit |= set(range(i, i + 8))
    seen, again = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            again += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(hit), failed


@pytest.mark.parametrize("source", ["driver", "odd"])
def test_quality_rules(spark, source):
    docs = documents(spark) if source == "driver" else odd_documents(spark)
    want = Counter((r["doc_id"], *brute_rules(r["text"])) for r in docs.collect())
    got = quality_rules.quality_rules(docs).collect()
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
                   for r in got) == want
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert quality_rules.quality_rules(empty_documents(spark)).count() == 0


def test_compression_bands():
    random.seed(1)
    prose = " ".join("".join(random.choice("etaoinshr") for _ in range(random.randint(2, 9))) for _ in range(900))
    judge = quality_rules.Compressor().judge
    assert judge(prose.encode())[3]
    assert not judge(b"buy now " * 900)[3]
    assert not judge(bytes(random.randrange(33, 127) for _ in range(40)) * 1 + random.randbytes(8000))[3]
    assert judge(b"") == (0.0, 0, 0, True)
    half = prose.encode()[:4096] + b"spam " * 4000  # chunks tell what the whole may hide
    assert judge(half)[2] >= 4


# ---- classifier, language, toxicity

def accuracy(spark, scored, column, wanted):
    joined = scored.join(wanted, "doc_id").filter("held_out")
    return joined.agg(F.avg((F.col(column) == F.col("want")).cast("double"))).first()[0]


def test_quality_classifier(spark):
    sf = "/root/testdata/sf0.01"
    marks = table(spark, sf, "labels")
    got = quality_classifier.classify(table(spark, sf, "documents"), marks).cache()
    assert accuracy(spark, got, "predicted", marks.select("doc_id", F.col("quality").alias("want"))) >= 0.95
    folds = {r["doc_id"]: r["held_out"] for r in got.collect()}
    assert all(f == (zlib.crc32(str(d).encode()) % 4 == 2) for d, f in folds.items())
    odd = quality_classifier.classify(odd_documents(spark), labels(spark, (5, 1, 0), (9, 0, 0), (4, None, 1), (8, 7, 0))).collect()
    assert len(odd) == 12 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in odd)
    assert quality_classifier.classify(empty_documents(spark), labels(spark)).count() == 0


def test_discriminant_uses_covariance():
    """Two classes with one mean and different spread are told apart, as only a quadratic rule can."""
    assert np.allclose(quality_classifier.document_statistics([""]), quality_classifier.document_statistics([" "])[:, :] * 1, atol=1)
    d = quality_classifier.document_statistics(["a few plain words here.", "LOUD!! LOUD!! LOUD!!"])
    assert d.shape == (2, len(quality_classifier.FEATURES)) and np.isfinite(d).all()


def test_language(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    got = language_id.identify(docs)
    assert accuracy(spark, got, "lang_pred", docs.select("doc_id", F.col("lang").alias("want"))) >= 0.95
    odd = language_id.identify(odd_documents(spark)).collect()
    assert len(odd) == 12 and all(0 <= r["score"] <= 1 for r in odd)
    assert {r["lang_pred"] for r in odd if r["doc_id"] in (1, 2, 3, 8)} == {"und"}
    assert language_id.identify(empty_documents(spark)).count() == 0
    assert language_id.family_of("de") == language_id.family_of("en") != language_id.family_of("fr")


def test_block_max_search_is_exact():
    rng = np.random.default_rng(2)
    vectors = []
    for _ in range(500):
        t = np.sort(rng.choice(60, rng.integers(0, 8), replace=False))
        w = rng.choice([0.5, 1.0, 2.0], len(t))
        vectors.append((t, w / np.sqrt((w ** 2).sum()) if len(t) else w))
    dense = np.zeros((500, 60))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    index = toxicity.BlockMaxIndex(vectors, 60, block=16)
    for j in range(0, 500, 7):
        t, w = vectors[j]
        if not len(t):
            continue
        full = dense @ dense[j]
        full[j] = 0
        order = [i for i in np.lexsort((np.arange(500), -full.round(12))) if full[i] > 0][:10]
        ids, cosines = index.search(t, w, 10, skip=j)
        assert ids.tolist() == order and np.allclose(cosines, np.minimum(full[order], 1))


def test_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    marks = table(spark, sf, "labels")
    got = toxicity.classify(table(spark, sf, "documents"), marks).cache()
    assert accuracy(spark, got, "predicted", marks.select("doc_id", F.col("toxic").alias("want"))) >= 0.9
    assert got.filter("predicted = 1 AND size(evidence) = 0").count() == 0
    odd = toxicity.classify(odd_documents(spark), labels(spark, (5, 1, 0), (9, 0, 1), (9, 0, 1), (4, None, None))).collect()
    assert len(odd) == 12 and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.classify(empty_documents(spark), labels(spark)).count() == 0


# ---- SimHash

def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    words = [w for w in text.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(keys):
    label = list(range(len(keys)))
    def find(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in range(len(keys)):
        for j in range(i):
            if bin(keys[i] ^ keys[j]).count("1") <= 4:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(keys))]


@pytest.mark.parametrize("source", ["driver", "odd"])
def test_near_duplicates(spark, source):
    docs = documents(spark) if source == "driver" else odd_documents(spark)
    rows = docs.collect()
    prints = [brute_fingerprint(r["text"]) for r in rows]
    roots = brute_components(prints)
    first = defaultdict(list)
    for r, root in zip(rows, roots):
        first[root].append(r["doc_id"])
    name = {k: min((x for x in v if x is not None), default=None) for k, v in first.items()}
    want = Counter((r["doc_id"], f"{p:016x}", name[root]) for r, p, root in zip(rows, prints, roots))
    got = simhash.near_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    kept = kept.collect()
    assert len(kept) == len(first)
    assert Counter(r["doc_id"] for r in kept) == Counter(name.values())


def test_crowded_shards_lose_no_link(spark):
    """Shards over the limit are dealt again and cut into chunks; the components stay the same."""
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(3)]
    keys = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(1, 4))) for b in base for _ in range(120)})
    frame = spark.createDataFrame([(simhash._signed(k),) for k in keys], "fp long")
    want = brute_components(keys)
    for shard, depth in ((8, 1), (8, 3), (1024, 4)):
        found = {r["node"]: r["root"] for r in simhash.components(simhash.links(frame, shard=shard, depth=depth)).collect()}
        got = [found.get(simhash._signed(k), simhash._signed(k)) for k in keys]
        assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_bk_tree():
    rng = np.random.default_rng(6)
    keys = np.unique(rng.integers(0, 1 << 16, 400).astype(np.uint64))
    rng.shuffle(keys)
    got = {(int(a), int(b)) for q, n in simhash.BKTree(keys).within(keys, 3) for a, b in zip(q, n)}
    far = np.bitwise_count(keys[:, None] ^ keys[None, :])
    assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(far <= 3))}
    assert not list(simhash.BKTree(keys[:0]).within(keys, 3))


# ---- token operators

def library_ids(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("source", ["driver", "odd"])
def test_bpe(spark, source):
    docs = documents(spark) if source == "driver" else odd_documents(spark)
    t = Tokenizer.from_file(WORD)
    want = Counter()
    for r in docs.collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        want[r["doc_id"], np.array(ids, "<u4").tobytes(), t.decode(ids, skip_special_tokens=False)] += 1
    got = bpe.decode(bpe.encode(docs, WORD, leaf=2000), WORD).collect()
    assert Counter((r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in got) == want
    assert bpe.encode(empty_documents(spark), WORD).count() == 0


@pytest.mark.parametrize("path,kind", [(WORD, "word"), (BYTE, "byte")])
def test_tree_concatenation(path, kind):
    lib = encoding.encoder(path, kind).library
    rng = random.Random(7)
    parts = ["abcdefgh", "the", "é", "́", "ß", "日本語", "'s", "'", "re", "12", "  ", "\n", "<|endoftext|>", "A", "각", "!!", "_"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 900))) for _ in range(60)]
    texts += ["".join(rng.choice("abcdeghnorst") for _ in range(3000)) for _ in range(5)] + ["語" * 1000, "a" * 3000, "", "x"]
    for text in texts:
        want = lib.encode(text, add_special_tokens=False).ids
        assert bpe.tree_encode(lib, text, 48).tolist() == want
        cuts = [len(text) * i // 4 for i in range(5)]
        ids = bpe._tree(lib, [bpe._leaf(lib, text[a:b]) for a, b in zip(cuts, cuts[1:])])
        assert ids is None or np.frombuffer(ids, "<u4").tolist() == want
        assert np.frombuffer(encoding.encoder(path, kind).encode([text])[0], "<u4").tolist() == want


@pytest.mark.parametrize("source", ["driver", "odd"])
def test_token_files(spark, source):
    docs = documents(spark) if source == "driver" else odd_documents(spark)
    t = Tokenizer.from_file(BYTE)
    rows = [(r["doc_id"], t.encode(r["text"] or "", add_special_tokens=False).ids + [2]) for r in docs.collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, len(r[1])))
    got = token_files.round_trip(docs, BYTE, shard_ids=20_000, block_ids=3_000).collect()
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in got) == Counter((d, np.array(i, "<u4").tobytes()) for d, i in rows)
    got.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [d for d, _ in rows]
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] * 4 == len(r["ids"])
        at += r["n_tokens"]
    assert token_files.round_trip(empty_documents(spark), BYTE).count() == 0


def test_rank_coding():
    rng = np.random.default_rng(8)
    for n in (0, 1, 3, 4, 5, 1000):
        r = (2 ** rng.uniform(0, 32, n)).astype(np.uint32)
        control, data = token_files.pack_ranks(r)
        assert len(control) == -(-n // 4)
        assert (token_files.unpack_ranks(control, data, n) == r).all()


def check_packing(rows, want, capacity):
    """Every document's ids are covered by its pieces; sequences are gapless and not overfull."""
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    for doc, parts in pieces.items():
        whole = sum(r["length"] for r in parts)
        assert whole == sum(map(len, want[doc]))
    cut = Counter((d, s, len(i[s:e]), zlib.crc32(np.array(i[s:e], "<u4").tobytes()))
                  for d, lists in want.items() for i in lists
                  for s, e in packing_cuts(len(i), capacity))
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == cut
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def packing_cuts(n, capacity):
    first = n - (n - 1) // capacity * capacity
    ends = list(range(first, n + 1, capacity))
    return list(zip([0, *ends[:-1]], ends))


@pytest.mark.parametrize("source", ["driver", "odd"])
def test_packing(spark, source):
    docs = documents(spark) if source == "driver" else odd_documents(spark)
    t = Tokenizer.from_file(BYTE)
    want = defaultdict(list)
    for r in docs.collect():
        want[r["doc_id"]].append(t.encode(r["text"] or "", add_special_tokens=False).ids + [2])
    bins = check_packing(packing.pack_documents(docs, BYTE).collect(), want, 1024)
    total = sum(len(i) for lists in want.values() for i in lists)
    assert bins <= -(-total // 1024) * 1.05 + 1
    assert packing.pack_documents(empty_documents(spark), BYTE).count() == 0


def test_bin_completion_is_optimal_on_small_sets():
    def fewest(items, room):
        best = [len(items)]
        def put(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(items):
                best[0] = len(bins)
                return
            for j in range(len(bins)):
                if bins[j] + items[i] <= room:
                    bins[j] += items[i]
                    put(i + 1, bins)
                    bins[j] -= items[i]
            put(i + 1, [*bins, items[i]])
        put(0, [])
        return best[0]

    for seed in range(60):
        rng = random.Random(seed)
        items = sorted((rng.randint(1, 20) for _ in range(9)), reverse=True)
        plan = packing.bin_completion(dict(Counter(items)), 25)
        assert Counter(s for f, n in plan for s in f for _ in range(n)) == Counter(items)
        assert all(sum(f) <= 25 for f, _ in plan)
        assert sum(n for _, n in plan) == fewest(items, 25)


# ---- WARC

def test_warc(spark):
    pages = spark.createDataFrame([
        (1, "http://a/1", "same", "x"), (2, None, "same", "x"), (9, "http://ä b/\r\n2", "same", "x"), (3, "http://c", None, "x"),
        (4, "http://c", "", "x"), (5, "http://d", "é" * 200_000, "x"), (6, "http://e", "own", "x"), (6, "http://e", "own", "x"),
        (None, "http://f", "same", "x"), (None, "http://g", "alone", "x"), (None, "http://h", "alone", "x"),
    ], "page_id long, url string, html string, payload string")
    got = warc.archive(pages, shard_bytes=64, roll_bytes=200).collect()
    texts = {"same": 4, "": 2, "own": 2, "alone": 2, "é" * 200_000: 1}
    assert Counter(r["payload_digest"] for r in got) == Counter({warc._sha1(t.encode()): n for t, n in texts.items()})
    kinds = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got)
    assert kinds == Counter({
        (1, "revisit", 9): 1, (2, "revisit", 9): 1, (9, "response", None): 1, (None, "revisit", 9): 1, (3, "revisit", 4): 1,
        (4, "response", None): 1, (5, "response", None): 1, (6, "response", None): 1, (6, "revisit", 6): 1,
        (None, "response", None): 1, (None, "revisit", None): 1})
    assert warc.archive(pages.filter("page_id > 99")).count() == 0


def test_warc_files_do_not_depend_on_layout(spark, tmp_path):
    pages = table(spark, SF, "pages")
    a = warc.write_warc(pages, f"{tmp_path}/a", shard_bytes=100_000, roll_bytes=8_000)
    b = warc.write_warc(pages.repartition(7, "url"), f"{tmp_path}/b", shard_bytes=100_000, roll_bytes=8_000)
    names = lambda m: sorted((r["name"], r["sha256"]) for r in m.collect())
    assert names(a) == names(b) and len(names(a)) > 3
    for name, sha in names(a):
        assert hashlib.sha256((tmp_path / "a" / name).read_bytes()).hexdigest() == sha
    body = warc.read_warc(a, f"{tmp_path}/a", payload=True).filter("record_type = 'response'").collect()
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    assert all(bytes(r["payload"]).decode() == html[r["page_id"]] for r in body)


def test_ranges_cut_clustered_keys(spark):
    keys = [*range(1000), 10 ** 15, 10 ** 15 + 1, *[5] * 500]
    frame = spark.createDataFrame([(k, 1) for k in keys], "k long, w long")
    bounds = range_bounds(frame, "k", "w", 100)
    counts = Counter(r["s"] for r in with_range(frame, "k", bounds, "s").collect())
    assert max(n for s, n in counts.items() if s != with_range(frame, "k", bounds, "s").filter("k = 5").first()["s"]) <= 100
    assert range_bounds(frame.filter("k < 0"), "k", "w", 100) == []


# ---- nearest neighbours

def test_nearest(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 8))
    x = (centres[rng.integers(0, 12, 3000)] + 0.2 * rng.normal(size=(3000, 8))).astype(np.float32)
    x[100:900] = x[100]  # a crowded vector
    rows = [(i, [float(v) for v in x[i]], 0.0) for i in range(3000)]
    rows += [(5000, None, 0.0), (5100, [0.0] * 8, 0.0), (5200, [float("nan")] + [1.0] * 7, 0.0), (5300, [None] + [1.0] * 7, 0.0),
             (5400, [1.0, 2.0], 0.0), (None, [1.0] * 8, 0.0), (200, [float(v) for v in x[200]], 0.0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double")
    got = defaultdict(list)
    for r in nearest.search(frame).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 3000, 100))
    hit = 0
    for q, found in got.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(3000), d))[:10]
        hit += len({i for i, _ in found} & set(best.tolist()))
        assert len(found) == 10 and all(abs(d[i] - s) < 1e-12 for i, s in found)
        assert [(s, i) for i, s in found] == sorted((s, i) for i, s in found)
    assert hit / 300 >= 0.9
    assert nearest.search(frame.filter("vec_id > 4000")).count() == 0
    few = nearest.search(frame.filter("vec_id IN (0, 1, 2)")).collect()
    assert [(r["query_id"], r["rank"]) for r in few] == [(0, 1), (0, 2)]


# ---- pipeline

def test_pipeline_stages(spark):
    docs = documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns
        docs = spark.createDataFrame(kept.collect(), kept.schema)
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    t = Tokenizer.from_file(BYTE)
    want = defaultdict(list)
    for r in docs.collect():
        want[r["doc_id"]].append(t.encode(r["text"] or "", add_special_tokens=False).ids + [2])
    check_packing(rows, want, 1024)
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["ids_crc32"])
    assert Counter(map(key, corpus_pipeline.run(spark, SF).collect())) == Counter(map(key, rows))


def test_pipeline_on_odd_tables(spark):
    docs = odd_documents(spark)
    for _, stage in corpus_pipeline.STAGES:
        for frame in (docs, empty_documents(spark)):
            stage(spark, frame, SF).collect()


def test_op4_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    got = queries.QUERIES["op4_warc"](spark, SF)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLES['op4_warc']})").fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(want)
