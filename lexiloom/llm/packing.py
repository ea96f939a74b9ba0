"""Best-two-fit packing of texts into containers of one capacity.

Only a size's count matters to a packing, so the plan is made on the histogram of sizes: at most capacity + 1 rows, however many
documents there are. A pattern (the sizes of one container) is laid out as often as the counts allow, which at least halves one
size's count: there are at most capacity x log2(documents) patterns. Documents then take their places by rank within their size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.sizes import VOCABULARY, sized

MAX_CAPACITY = 1 << 20
#: Documents of one size are ranked in groups of about this many.
RANK_GROUP = 1_000_000


@dataclass
class Plan:
    """Place k: documents of size[k] with ranks from start[k] on, per[k] to a container, from container bin0[k] on. Sorted by size, start."""

    size: np.ndarray
    start: np.ndarray
    per: np.ndarray
    bin0: np.ndarray
    bins: int


class _Left:
    """Counts of sizes left, with the sizes that are left as bits: in blocks, to find the next smaller one; and as one number and its mirror, to find pairs of a given sum."""

    BLOCK = 1024

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts.tolist()
        self.capacity = len(self.counts) - 1
        self.blocks = [0] * (self.capacity // self.BLOCK + 1)
        self.used_blocks = self.all = self.mirror = 0
        for s in np.flatnonzero(counts).tolist():
            self._flip(s)

    def _flip(self, s: int) -> None:
        i, j = divmod(s, self.BLOCK)
        self.blocks[i] ^= 1 << j
        if bool(self.blocks[i]) != bool(self.used_blocks >> i & 1):
            self.used_blocks ^= 1 << i
        self.all ^= 1 << s
        self.mirror ^= 1 << self.capacity - s

    def change(self, s: int, by: int) -> None:
        had = self.counts[s]
        self.counts[s] = had + by
        if bool(had) != bool(had + by):
            self._flip(s)

    def below(self, x: int) -> int:
        """The largest size <= x that is left, or -1."""
        i, j = divmod(x, self.BLOCK)
        here = self.blocks[i] & (1 << j + 1) - 1
        if here:
            return i * self.BLOCK + here.bit_length() - 1
        lower = self.used_blocks & (1 << i) - 1
        return (lower.bit_length() - 1) * self.BLOCK + self.blocks[lower.bit_length() - 1].bit_length() - 1 if lower else -1

    def pair(self, least: int, most: int) -> tuple[int, int] | None:
        """Two items left, of the greatest sum over least and up to most, and as even as such a sum allows."""
        for total in range(most, least, -1):
            smaller = self.all & self.mirror >> self.capacity - total & (1 << total // 2 + 1) - 1
            while smaller:
                b = smaller.bit_length() - 1
                if 2 * b < total or self.counts[b] > 1:
                    return total - b, b
                smaller ^= 1 << b
        return None


def _pattern(left: _Left, two_fit: bool) -> dict[int, int]:
    """The sizes of the next container, with their numbers; takes them from those left."""
    used: dict[int, int] = {}
    gap = left.capacity

    def take(s: int) -> None:
        nonlocal gap
        left.change(s, -1)
        used[s] = used.get(s, 0) + 1
        gap -= s

    while gap and (s := left.below(gap)) > 0:
        take(s)
    while two_fit and gap and used:
        least = min(used)
        two = left.pair(least, gap + least)
        if two is None:
            break
        used[least] -= 1
        if not used[least]:
            del used[least]
        left.change(least, 1)
        gap += least
        for s in two:
            take(s)
    return used


def plan(counts: np.ndarray, two_fit: bool = True) -> Plan:
    """counts[s]: documents of size s, for s from 0 to the capacity. Size 0 takes no place here."""
    counts = counts.copy()
    counts[0] = 0
    left = _Left(counts)
    given = [0] * len(counts)
    rows: list[tuple[int, int, int, int]] = []
    bins = 0
    while left.all:
        used = _pattern(left, two_fit)
        times = 1 + min(left.counts[s] // u for s, u in used.items())
        for s, u in used.items():
            rows.append((s, given[s], u, bins))
            given[s] += u * times
            if times > 1:
                left.change(s, -u * (times - 1))
        bins += times
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 4).T
    return Plan(*cols, bins)


def pack(items: DataFrame, capacity: int, key: str = "doc_id", two_fit: bool = True) -> DataFrame:
    """(key, part, start, tokens, size, bin) for items of (key, size): every piece of every item, in its container.

    An item over the capacity fills containers of its own (bins `key/part`); its rest is packed as a piece like others. Any other
    item is one piece. Items of size 0 or NULL are spread over all containers; if there is none, bin is NULL. No items, no rows.
    Repeated rows are items of their own.
    """
    if not 0 < capacity <= MAX_CAPACITY:
        raise ValueError(f"capacity must be from 1 to {MAX_CAPACITY}")
    spark = items.sparkSession
    base = items.select(F.col(key).alias("_id"), F.coalesce("size", F.lit(0)).cast("long").alias("size"))
    whole = F.floor(F.col("size") / capacity) - F.when((F.col("size") > 0) & (F.col("size") % capacity == 0), 1).otherwise(0)
    base = base.withColumn("part", whole.cast("int")).withColumn("tokens", F.col("size") - F.col("part") * capacity)
    counts = np.zeros(capacity + 1, np.int64)
    for r in base.groupBy("tokens").count().collect():  # at most capacity + 1 rows
        counts[r["tokens"]] = r["count"]
    p = plan(counts, two_fit)
    groups = 1 + int(counts.max()) // RANK_GROUP
    grouped = base.withColumn("_g", F.pmod(F.xxhash64("_id"), F.lit(groups)).cast("int"))
    by_size = Window.partitionBy("tokens").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)  # `groups` rows each
    offsets = grouped.groupBy("tokens", "_g").count().select("tokens", "_g", F.coalesce(F.sum("count").over(by_size), F.lit(0)).alias("_before"))
    within = Window.partitionBy("tokens", "_g").orderBy("_id", "part")
    ranked = grouped.withColumn("_r", F.row_number().over(within) - 1)
    ranked = ranked.join(offsets, ["tokens", "_g"]) if groups > 1 else ranked.withColumn("_before", F.lit(0))
    # one number orders the places: the size, then the rank
    bits = max(1, int(counts.max()).bit_length())
    if bits + capacity.bit_length() > 62:
        raise ValueError("sizes and counts exceed 62 bits together")
    starts = (p.size << bits) + p.start

    @F.pandas_udf("bigint")
    def place(tokens: pd.Series, rank: pd.Series) -> pd.Series:
        t, r = tokens.to_numpy(np.int64), rank.to_numpy(np.int64)
        if not p.bins:
            return pd.Series([None] * len(t), dtype="Int64")
        k = np.maximum(np.searchsorted(starts, (t << bits) + r, side="right") - 1, 0)
        return pd.Series(np.where(t > 0, p.bin0[k] + (r - p.start[k]) // p.per[k], r % p.bins))

    last = ranked.select("_id", "part", "tokens", "size", place("tokens", F.col("_r") + F.col("_before")).cast("string").alias("bin"))
    full = base.where(F.col("part") > 0).select("_id", F.explode(F.sequence(F.lit(0), F.col("part") - 1)).alias("part"), F.lit(capacity).cast("long").alias("tokens"), "size")
    full = full.withColumn("bin", F.concat_ws("/", F.col("_id").cast("string"), F.col("part").cast("string")))
    out = last.unionByName(full)
    return out.select(F.col("_id").alias(key), "part", (F.col("part").cast("long") * capacity).alias("start"), "tokens", "size", "bin")


def pack_texts(docs: DataFrame, capacity: int, key: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    return pack(sized(docs, key, vocabulary=vocabulary), capacity, key)


def over_capacity(packed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keys that had to be split."""
    return packed.where(F.col("part") == 1).select(key).distinct()


def fill(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, and the share of the room that is used (NULL without containers)."""
    n, t = F.count_distinct("bin"), F.sum("tokens")
    return packed.agg(n.alias("bins"), F.coalesce(t, F.lit(0)).alias("tokens")).withColumn("used", F.round(F.col("tokens") / F.nullif(F.col("bins") * capacity, F.lit(0)), 6))
