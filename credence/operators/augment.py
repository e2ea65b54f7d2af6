"""Seeded text noise. Every draw depends on (key, seed, position) only, so any layout gives the same text."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credence import constants as K
from credence.functions.hashing import TWO32, hash32, position_hash, position_uniform, uniform
from credence.operators.layout import arrow_batches, ranked

ARMS = ["keyboard_typos", "punct_burst", "emoji", "homoglyphs", "nikud_space"]
MIXED_ARMS = ["keyboard_typos", "punct_burst", "nikud_space"]


def pick(values: str | list[str], draw: Column) -> Column:
    """Element of a constant list by a hash draw."""
    items = F.array(*[F.lit(v) for v in values]) if isinstance(values, list) else F.split(F.lit(values), "")
    return F.element_at(items, (F.pmod(draw, F.lit(len(values))) + 1).cast("int"))


# characters whose draws are made at once
DRAWS = 1_000_000


def _position_draws(seeds: np.ndarray, positions: np.ndarray, stream: int = 0) -> np.ndarray:
    """position_hash of whole arrays."""
    x = (seeds + positions * 2654435 + stream * 40503) % TWO32
    x = (x * 1103515245 + 12345) % TWO32
    x ^= x >> 15
    x = (x * 1664525 + 1013904223) % TWO32
    return x ^ (x >> 13)


def _typos(texts: list[str], seeds: np.ndarray, p: np.ndarray) -> list[str]:
    """keyboard_typos of some texts, all characters side by side; an empty text has one place, which only a replacement fills."""
    letters = np.array([ord(ch) for ch in K.TYPO_ALPHABET], np.uint32)
    sizes = np.array([max(1, len(t)) for t in texts])
    code = np.frombuffer("".join(t or "\0" for t in texts).encode("utf-32-le"), np.uint32).copy()
    times = np.ones(len(code), np.int8)
    ends = np.cumsum(sizes)
    times[(ends - sizes)[np.array([t == "" for t in texts], bool)]] = 0
    for at in range(0, len(code), DRAWS):
        place = np.arange(at, min(at + DRAWS, len(code)))
        row = np.searchsorted(ends, place, "right")
        position = place - (ends - sizes)[row]
        u, rate = _position_draws(seeds[row], position) / TWO32, p[row]
        changed = np.flatnonzero(u < rate)
        u, rate, spots = u[changed], rate[changed], place[changed]
        drop, swap = u < rate / 3, u >= 2 * rate / 3
        times[spots] *= np.where(drop, 0, 2).astype(np.int8)
        swapped = spots[swap]
        code[swapped] = letters[_position_draws(seeds[row[changed[swap]]], position[changed[swap]], 1) % len(letters)]
        times[swapped] = 1
    out = np.repeat(code, times).tobytes().decode("utf-32-le")
    cuts = np.r_[0, np.cumsum(times, dtype=np.int64)[ends - 1]]
    return [out[a:b] for a, b in zip(cuts, cuts[1:])]


def keyboard_typos(c: Column, seed: Column, p: float | Column = 0.03) -> Column:
    """A third of p each: drop, double or replace a character."""
    @F.arrow_udf("string")
    def change(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, seeds, rates in batches:
            # without a seed or a rate nothing is drawn
            rates = pc.if_else(pc.is_valid(seeds), rates, None)
            plain, waiting, size = texts.to_pylist(), [], 0
            seeds, rates = (pc.fill_null(x, 0).to_numpy(zero_copy_only=False) for x in (seeds, rates))
            for i, t in enumerate(plain):
                if t is not None:
                    waiting.append(i)
                    size += len(t)
                if waiting and (size >= DRAWS or i == len(plain) - 1):
                    for j, noisy in zip(waiting, _typos([plain[j] for j in waiting], seeds[waiting], rates[waiting])):
                        plain[j] = noisy
                    waiting, size = [], 0
            yield pa.array(plain, pa.string())

    return change(c, seed.cast("bigint"), (F.lit(p) if isinstance(p, float) else p).cast("double"))


def punct_burst(c: Column, seed: Column, p: float = 0.2) -> Column:
    """Repeat !, ? and ... up to three times."""
    def change(piece: Column, i: Column) -> Column:
        times = (F.pmod(position_hash(seed, i, 1), F.lit(3)) + 1).cast("int")
        burst = piece.isin("!", "?", "...") & (position_uniform(seed, i) < p)
        return F.when(burst, F.repeat(piece, times)).otherwise(piece)
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"(?s)(\.\.\.|!|\?|[^!?.]+|\.)"), F.lit(1)), change), "")


def emoji(c: Column, seed: Column, p: float = 0.2) -> Column:
    """An emoji in front, else perhaps one at the end."""
    zero, one = F.lit(0), F.lit(1)
    return (
        F.when(position_uniform(seed, zero) < p, F.concat(pick(K.EMOJIS, position_hash(seed, zero, 1)), F.lit(" "), c))
        .when(position_uniform(seed, one) < p, F.concat(c, F.lit(" "), pick(K.EMOJIS, position_hash(seed, one, 1))))
        .otherwise(c)
    )


def homoglyphs(c: Column, seed: Column, p: float = 0.05) -> Column:
    """Swap letters for look-alike digits."""
    before, after = "".join(K.HOMOGLYPHS), "".join(K.HOMOGLYPHS.values())

    def change(ch: Column, i: Column) -> Column:
        return F.when(position_uniform(seed, i) < p, F.translate(ch, before, after)).otherwise(ch)
    return F.array_join(F.transform(F.split(c, ""), change), "")


def nikud_space(c: Column, seed: Column, p: float = 0.05) -> Column:
    """Hebrew marks out; with probability p a whitespace character becomes one or two of itself, evenly."""
    def change(ch: Column, i: Column) -> Column:
        double = F.rlike(ch, F.lit(r"(?U)^\s$")) & (position_uniform(seed, i) < F.lit(p) / 2)
        return F.when(double, F.concat(ch, ch)).otherwise(ch)
    return F.array_join(F.transform(F.split(F.regexp_replace(c, K.HEBREW_MARKS, ""), ""), change), "")


NOISES = {"keyboard_typos": keyboard_typos, "punct_burst": punct_burst, "emoji": emoji,
          "homoglyphs": homoglyphs, "nikud_space": nikud_space}


def augment(df: DataFrame, key: str, column: str, arm: str | None = None, fraction: float = 0.7,
            seed: int = 42, out: str | None = None, p: float | Column | None = None) -> DataFrame:
    """Noise a fraction of the rows with one arm, or (arm=None) with a random arm of the mix per row."""
    arrow_batches(df.sparkSession)
    text, draw = F.col(column), F.col("_seed")
    extra = {} if p is None else {"p": p}
    if arm is not None:
        noisy = NOISES[arm](text, draw, **extra)
    else:
        which = F.pmod(hash32(F.col(key), f"{seed}-arm"), F.lit(len(MIXED_ARMS)))
        noisy = F.when(which == 0, NOISES[MIXED_ARMS[0]](text, draw))
        for n, name in enumerate(MIXED_ARMS[1:], 1):
            noisy = noisy.when(which == n, NOISES[name](text, draw))
    chosen = uniform(F.col(key), f"{seed}-row") < fraction
    seeded = df.withColumn("_seed", hash32(F.col(key), f"{seed}-text"))
    return seeded.withColumn(out or column, F.when(chosen, noisy).otherwise(text)).drop("_seed")


def arm_values(rewards: DataFrame, arm: str, order: str, key: str, reward: str, alpha: float = 0.2) -> DataFrame:
    """Exponentially weighted reward and count per arm, in the order of the log.

    A reward that n later rewards of its arm follow weighs alpha * (1 - alpha)^n, so the recursion is a
    plain sum once the ranks are known; ranks are found range by range, never one arm in one task.
    """
    placed = ranked(rewards.select(arm, key, reward, order), [arm], order, [key], "_r")
    weight = alpha * F.pow(F.lit(1.0 - alpha), F.col("_r_of") - F.col("_r"))
    return placed.groupBy(arm).agg(F.sum(weight * F.col(reward)).alias("value"), F.count("*").alias("n"))


def epsilon(step: int, steps: int, start: float = 0.3, end: float = 0.05) -> float:
    """Exploration rate, falling in a straight line."""
    return start + (end - start) * step / max(1, steps - 1)


def choose_arm(values: DataFrame, arm: str, step: int, eps: float, seed: int = 42) -> DataFrame:
    """One arm: random with probability eps, else the best; equal values are broken at random."""
    draw = uniform(F.lit(step), f"{seed}-explore")
    tie = hash32(F.col(arm), f"{seed}-{step}")
    explore = draw < eps
    order = F.when(explore, F.lit(0.0)).otherwise(F.round("value", 12))
    return values.select(arm, "value", "n", explore.alias("explored"), order.alias("_o"), tie.alias("_t")).orderBy(
        F.desc("_o"), F.desc("_t"), arm).limit(1).drop("_o", "_t")


def noise_grid(df: DataFrame, key: str, column: str, grid: dict[str, list[float]], seed: int = 42) -> DataFrame:
    """The clean rows plus every row under every (noise, intensity); intensity is the noise's rate."""
    parts = [df.withColumns({"noise": F.lit("clean"), "intensity": F.lit(0.0)})]
    for arm, rates in grid.items():
        for rate in rates:
            noisy = augment(df, key, column, arm, 1.0, seed, p=rate)
            parts.append(noisy.withColumns({"noise": F.lit(arm), "intensity": F.lit(float(rate))}))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
