"""Conversation prefix trie: shared openings of rebuilt conversations, as nodes with member and subtree totals.

Turns are ordered by turn (null first, ties by role then text); null role or text is ''. Conversation c is
rebuilt from the first h = crc32(decimal c) mod 9 turns of conversation c - c % 5 (all if fewer, none if absent)
followed by its own turns after its first h. Each distinct sequence of the first d rebuilt turns (role, text) is
a node of depth d; the root (d = 0) holds every conversation, even turnless ones. Per node: conv_id (smallest
member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves (childless nodes of its subtree),
saved_tokens (over its subtree, (n_convs - 1) x UTF-8 bytes of the node's last text) and ends_sha256 (SHA-256 of
the ascending, comma-joined ids of the members that end there; none: hash of '').

Method. Turns become 96-bit ids (two hashes of role and text); equal rebuilt conversations are folded into one
sequence with a weight. Sequences are cut into prefix shards: a prefix of depth d held by at most SHARD_SEQS
distinct sequences is a shard; longer-shared (hot) prefixes are split one turn deeper, level by level, so no
shard grows with a hot opening. Shards are dealt by prefix hash into buckets of about SHARD_SEQS sequences; a
bucket is one task: it numbers its turns densely, packs a double-array trie
(BASE and CHECK arrays, a child of slot t with turn c at BASE[t] + c, owned if CHECK[BASE[t] + c] == t), walks
every sequence through it for member counts and minima, and sums subtrees bottom-up. The upper nodes that
shards share (the root and every hot prefix) are merged globally: members from every sequence below them,
children from hot prefixes and shard roots, subtree totals from the shard roots below them plus their own.
Ends are hashed in one ordered pass per node, a batch at a time, so a node that many copies end at is streamed.

Defined results: rows with a null conv_id take no part; repeated rows are turns of their own; an empty table
gives the root alone only if some conversation exists, else no rows. Two turns are one if their 96-bit ids agree
(chance of a false merge about n^2 / 2^97 for n distinct turns). Other columns are ignored.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credence.llm.common import small_batches, stored

# Fixed values of the contract.
HEAD_BASE = 5
HEAD_TURNS = 9
# Distinct sequences a prefix shard may hold before it is split one turn deeper.
SHARD_SEQS = 20_000
# Hot prefixes of one level that are broadcast to mark their sequences; more go through a shuffle join.
HOT_BROADCAST = 100_000

NODE_SCHEMA = ("kind string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
               "n_leaves long, saved_tokens long, h1s array<long>, h2s array<int>")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, h1s, h2s, nb): every conversation's rebuilt turns as ids and text byte lengths, in order."""
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").cast("binary"),
                                                  F.col("text").cast("binary"))
    turns = rows.select("conv_id", (F.row_number().over(order) - 1).alias("idx"),
                        F.xxhash64("role", "text").alias("h1"), F.hash("role", "text").alias("h2"),
                        F.octet_length("text").cast("long").alias("nb"))
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select(
        "conv_id", "n", (F.col("conv_id") - F.col("conv_id") % HEAD_BASE).alias("base"),
        (F.crc32(F.col("conv_id").cast("string")) % HEAD_TURNS).alias("h"))
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("bn"))
    convs = convs.join(bases, "base", "left").withColumn("m", F.least(F.col("h"), F.coalesce("bn", F.lit(0))))
    head = (convs.select("conv_id", "base", "h").join(
        turns.where(F.col("idx") < HEAD_TURNS).select(F.col("conv_id").alias("base"), "idx", "h1", "h2", "nb"), "base")
        .where(F.col("idx") < F.col("h")).select("conv_id", F.col("idx").alias("pos"), "h1", "h2", "nb"))
    own = (turns.join(convs.select("conv_id", "h", "m"), "conv_id").where(F.col("idx") >= F.col("h"))
           .select("conv_id", (F.col("m") + F.col("idx") - F.col("h")).alias("pos"), "h1", "h2", "nb"))
    seqs = (head.unionByName(own).groupBy("conv_id")
            .agg(F.array_sort(F.collect_list(F.struct("pos", "h1", "h2", "nb"))).alias("_s")))
    out = convs.select("conv_id").join(seqs, "conv_id", "left").select(
        "conv_id", *[F.coalesce(F.transform("_s", _field(c)), F.array().cast(t)).alias(a)
                     for c, a, t in (("h1", "h1s", "array<long>"), ("h2", "h2s", "array<int>"), ("nb", "nb", "array<long>"))])
    return out


def _field(name):
    return lambda x: x[name]


def _prefix(d):
    return [F.slice("h1s", 1, d).alias("k1"), F.slice("h2s", 1, d).alias("k2")]


def double_array(labels: list[list[int]]) -> tuple[list[int], list[int], list[int]]:
    """Pack sorted label sequences (labels >= 1) into BASE and CHECK; slot 0 is the root.

    Returns BASE, CHECK and the slots in breadth-first order. Children of slot t with labels C take slots
    BASE[t] + c for c in C, the smallest base at which all of them are free.
    """
    base, check, order = [0], [-2], [0]
    free_from = 1
    todo = [(0, 0, 0, len(labels))]
    while todo:
        nxt = []
        for slot, depth, lo, hi in todo:
            children, spans = [], []
            i = lo
            while i < hi and len(labels[i]) <= depth:
                i += 1
            while i < hi:
                c, j = labels[i][depth], i
                while j < hi and labels[j][depth] == c:
                    j += 1
                children.append(c)
                spans.append((i, j))
                i = j
            if not children:
                continue
            b = max(1, free_from - children[0])
            while True:
                top = b + children[-1]
                if top >= len(check):
                    grow = top + 1 - len(check)
                    check.extend([-1] * grow)
                    base.extend([0] * grow)
                if all(check[b + c] == -1 for c in children):
                    break
                b += 1
            base[slot] = b
            for c, (i, j) in zip(children, spans):
                check[b + c] = slot
                order.append(b + c)
                nxt.append((b + c, depth + 1, i, j))
            while free_from < len(check) and check[free_from] != -1:
                free_from += 1
        todo = nxt
    return base, check, order


def _shards(frame: pd.DataFrame) -> pd.DataFrame:
    """A bucket of prefix shards in one double-array trie; nodes at or below their shard's depth are emitted.

    Sequences of one shard share its first `s` turns, and every sequence through a node at depth >= s of that
    shard belongs to the shard, so those nodes are whole here; the nodes above (upper nodes) are skipped.
    """
    depth_of = frame["s"].to_numpy(np.int64)
    h1 = [np.asarray(x, dtype=np.int64) for x in frame["h1s"]]
    h2 = [np.asarray(x, dtype=np.int64) for x in frame["h2s"]]
    nb = [np.asarray(x, dtype=np.int64) for x in frame["nb"]]
    pairs = np.concatenate([np.stack([a, b], 1) for a, b in zip(h1, h2)] or [np.empty((0, 2), np.int64)])
    inverse = (np.unique(pairs, axis=0, return_inverse=True)[1] if len(pairs) else np.empty(0, np.int64))
    inverse = np.asarray(inverse).reshape(-1) + 1
    cuts = np.cumsum([0] + [len(a) for a in h1])
    labels = [inverse[cuts[i]:cuts[i + 1]].tolist() for i in range(len(h1))]
    order_seq = sorted(range(len(labels)), key=lambda i: labels[i])
    base, check, order = double_array([labels[i] for i in order_seq])
    size = len(check)
    members = np.zeros(size, np.int64)
    least = np.full(size, np.iinfo(np.int64).max)
    depth = np.zeros(size, np.int64)
    last = np.zeros(size, np.int64)
    top = np.full(size, np.iinfo(np.int64).max)
    kids = np.zeros(size, np.int64)
    w, m = frame["w"].to_numpy(np.int64), frame["m"].to_numpy(np.int64)
    ends = []
    for i in range(len(labels)):
        t = 0
        members[0] += w[i]
        least[0] = min(least[0], m[i])
        top[0] = min(top[0], depth_of[i])
        for d, c in enumerate(labels[i]):
            nxt = base[t] + c
            assert check[nxt] == t
            t = nxt
            members[t] += w[i]
            least[t] = min(least[t], m[i])
            depth[t] = d + 1
            last[t] = nb[i][d]
            top[t] = depth_of[i]
        ends.append(t)
    parent = np.full(size, -1)
    for t in order[1:]:
        parent[t] = check[t]
        kids[check[t]] += 1
    leaves = np.zeros(size, np.int64)
    saved = np.zeros(size, np.int64)
    for t in reversed(order):
        leaves[t] += 1 if kids[t] == 0 else 0
        saved[t] += (members[t] - 1) * last[t]
        if t:
            leaves[parent[t]] += leaves[t]
            saved[parent[t]] += saved[t]
    slots = np.asarray([t for t in order if depth[t] >= top[t]], dtype=np.int64)
    nodes = pd.DataFrame({
        "kind": "node", "conv_id": least[slots], "depth": depth[slots],
        "parent_conv_id": pd.array([None if depth[t] == top[t] else int(least[parent[t]]) for t in slots], dtype="Int64"),
        "n_convs": members[slots], "n_children": kids[slots], "n_leaves": leaves[slots], "saved_tokens": saved[slots],
        "h1s": None, "h2s": None})
    at = np.asarray(ends, dtype=np.int64)
    done = pd.DataFrame({
        "kind": "end", "conv_id": least[at], "depth": depth[at],
        "parent_conv_id": pd.array([None] * len(ends), dtype="Int64"), "n_convs": 0, "n_children": 0, "n_leaves": 0,
        "saved_tokens": 0, "h1s": frame["h1s"].tolist(), "h2s": frame["h2s"].tolist()})
    return pd.concat([nodes, done], ignore_index=True)


def _hash_ends(batches):
    """Rows sorted by (node, conv_id) within the partition: one SHA-256 per node, fed batch by batch."""
    node, digest, first = None, None, True
    for b in batches:
        out = []
        for c, d, conv in zip(b["conv_id"].tolist(), b["depth"].tolist(), b["member"].tolist()):
            if (c, d) != node:
                if node is not None:
                    out.append((*node, digest.hexdigest()))
                node, digest, first = (c, d), hashlib.sha256(), True
            digest.update((("" if first else ",") + str(conv)).encode())
            first = False
        if out:
            yield pd.DataFrame(out, columns=["conv_id", "depth", "ends_sha256"])
    if node is not None:
        yield pd.DataFrame([(*node, digest.hexdigest())], columns=["conv_id", "depth", "ends_sha256"])


def prefix_trie(conversations: DataFrame, shard_seqs: int = SHARD_SEQS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    convs = stored(rebuilt(conversations), "trie-rebuilt")
    seqs = stored(convs.groupBy("h1s", "h2s").agg(F.count(F.lit(1)).alias("w"), F.min("conv_id").alias("m"),
                                                  F.first("nb").alias("nb")).withColumn("L", F.size("h1s")), "trie-seqs")
    # Level by level: shards of cold prefixes, hot prefixes kept as upper nodes.
    open_seqs, shards, paths, d = seqs.where(F.col("L") > 0), [], [seqs.where(F.col("L") == 0).withColumn("s", F.lit(0))], 1
    while True:
        keyed = open_seqs.select("*", *_prefix(d))
        counts = keyed.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("_n"))
        hot = counts.where(F.col("_n") > shard_seqs).select("k1", "k2", F.lit(True).alias("_hot"))
        n_hot = hot.count()
        if n_hot == 0:
            shards.append(keyed.withColumn("s", F.lit(d)).drop("k1", "k2"))
            break
        marked = keyed.join(F.broadcast(hot) if n_hot <= HOT_BROADCAST else hot, ["k1", "k2"], "left")
        marked = stored(marked, f"trie-level{d}")
        shards.append(marked.where(F.col("_hot").isNull()).drop("k1", "k2", "_hot").withColumn("s", F.lit(d)))
        paths.append(marked.where(F.col("_hot") & (F.col("L") == d)).drop("k1", "k2", "_hot").withColumn("s", F.lit(d)))
        open_seqs = marked.where(F.col("_hot") & (F.col("L") > d)).drop("k1", "k2", "_hot")
        d += 1
    sharded = shards[0]
    for more in shards[1:]:
        sharded = sharded.unionByName(more)
    ended = paths[0]
    for more in paths[1:]:
        ended = ended.unionByName(more)

    small_batches(spark)
    keyed_shards = sharded.select("*", *_prefix(F.col("s")))
    # Shards are dealt by their prefix into buckets of about SHARD_SEQS sequences: one trie a bucket.
    buckets = max(1, -(-sharded.count() // shard_seqs))
    local = stored(keyed_shards.withColumn("_bucket", F.pmod(F.xxhash64("k1", "k2"), F.lit(buckets)))
                   .groupBy("_bucket").applyInPandas(_shards, NODE_SCHEMA), "trie-shards")

    # Upper nodes: the root and every hot prefix, from every sequence that passes or ends there.
    upper_from = (sharded.select("h1s", "h2s", "nb", "w", "m", F.col("s").alias("top"), F.lit(False).alias("_end"))
                  .unionByName(ended.select("h1s", "h2s", "nb", "w", "m", (F.col("s") + 1).alias("top"), F.lit(True).alias("_end"))))
    emitted = upper_from.select("h1s", "h2s", "nb", "w", "m", F.explode(F.sequence(F.lit(0), F.col("top") - 1)).alias("depth"))
    upper = (emitted.select(F.slice("h1s", 1, F.col("depth")).alias("k1"), F.slice("h2s", 1, F.col("depth")).alias("k2"),
                            "depth", "w", "m", F.when(F.col("depth") > 0, F.element_at("nb", F.col("depth"))).otherwise(0).alias("last"))
             .groupBy("k1", "k2", "depth").agg(F.sum("w").alias("n_convs"), F.min("m").alias("conv_id"), F.first("last").alias("last")))
    upper = stored(upper, "trie-upper")
    up = F.greatest(F.col("depth") - 1, F.lit(0))
    parent_key = [F.slice("k1", 1, up).alias("p1"), F.slice("k2", 1, up).alias("p2")]
    roots = keyed_shards.select("k1", "k2", F.col("s").alias("depth")).distinct()
    shard_roots = local.where((F.col("kind") == "node") & F.col("parent_conv_id").isNull())
    children = (upper.where(F.col("depth") > 0).select(*parent_key, "k1", "k2")
                .unionByName(roots.select(*parent_key, "k1", "k2")).distinct()
                .groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("n_children")))
    # Subtree totals of upper nodes: shard roots and their own parts, credited to every upper ancestor.
    shard_keys = (keyed_shards.select("k1", "k2", F.col("s").alias("depth"), "m").groupBy("k1", "k2", "depth")
                  .agg(F.min("m").alias("conv_id")))
    tops = shard_keys.join(shard_roots.select("conv_id", "depth", "n_leaves", "saved_tokens"), ["conv_id", "depth"])
    own_upper = upper.join(children.withColumnRenamed("p1", "k1").withColumnRenamed("p2", "k2"), ["k1", "k2"], "left").fillna(0, ["n_children"])
    credit = (tops.select("k1", "k2", "depth", "n_leaves", "saved_tokens")
              .unionByName(own_upper.select("k1", "k2", "depth", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"),
                                            ((F.col("n_convs") - 1) * F.col("last")).alias("saved_tokens")))
              .select("k1", "k2", "n_leaves", "saved_tokens", F.explode(F.sequence(F.lit(0), F.col("depth"))).alias("at"))
              .select(F.slice("k1", 1, F.col("at")).alias("k1"), F.slice("k2", 1, F.col("at")).alias("k2"), "n_leaves", "saved_tokens")
              .groupBy("k1", "k2").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")))
    credit = credit.join(upper.select("k1", "k2"), ["k1", "k2"])
    parents = upper.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    upper_nodes = (own_upper.join(credit, ["k1", "k2"]).select("*", *parent_key).join(parents, ["p1", "p2"], "left")
                   .select("conv_id", "depth", F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"),
                           "n_convs", "n_children", "n_leaves", "saved_tokens"))
    # Shard roots take their parent from the upper nodes.
    root_parent = (shard_keys.select("conv_id", "depth", *[F.slice(k, 1, F.col("depth") - 1).alias(p) for k, p in (("k1", "p1"), ("k2", "p2"))])
                   .join(parents, ["p1", "p2"]).select("conv_id", "depth", F.col("parent_conv_id").alias("_pc")))
    shard_nodes = (local.where(F.col("kind") == "node").join(root_parent, ["conv_id", "depth"], "left")
                   .select("conv_id", "depth", F.coalesce("parent_conv_id", "_pc").alias("parent_conv_id"),
                           "n_convs", "n_children", "n_leaves", "saved_tokens"))
    nodes = upper_nodes.unionByName(shard_nodes)

    # Ends: each conversation to the node its whole sequence reaches.
    end_of = (local.where(F.col("kind") == "end").select("h1s", "h2s", "conv_id", "depth")
              .unionByName(ended.select("h1s", "h2s", "L").join(
                  upper.select(F.col("k1").alias("h1s"), F.col("k2").alias("h2s"), "conv_id", "depth"), ["h1s", "h2s"])
                  .drop("L")))
    members = convs.select("h1s", "h2s", F.col("conv_id").alias("member")).join(end_of, ["h1s", "h2s"])
    hashed = (members.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "member")
              .select("conv_id", "depth", "member")
              .mapInPandas(_hash_ends, "conv_id long, depth long, ends_sha256 string"))
    return (nodes.join(hashed, ["conv_id", "depth"], "left")
            .select(*[F.col(c).cast("long").alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
                                                                "n_leaves", "saved_tokens")],
                    F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")))
