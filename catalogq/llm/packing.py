"""Texts of varying token length packed into containers of fixed capacity.

The plan is made over the histogram of lengths, not over documents: best fit for decreasing lengths, where all
items of a length that meet equal containers are placed at once. Documents then take the planned slots by their
rank within their length.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from catalogq.session import cut

#: Items of one length that one task ranks; more are cut into buckets.
RANKED_AT_ONCE = 100_000


def default_vocabulary() -> str:
    """The vocabulary file used unless another path is given: byte-level BPE of 50,256 ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@cache
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, key: str, text: str, vocabulary: str | None = None) -> DataFrame:
    """``key`` and ``n_tokens`` of every row; 0 for null and empty texts. The file must lie on every executor."""
    path = vocabulary or default_vocabulary()

    @pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        encode = _encoding(path).encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return df.select(key, count(F.col(text)).alias("n_tokens"))


class Plan:
    """Slots per length: segments of ranks, each with its first container and the items per container."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity, self.containers = capacity, 0
        self.segments: dict[int, list[tuple[int, int, int]]] = {}
        self.room: dict[int, list[tuple[int, int]]] = {}
        self.sizes: list[int] = []
        for length in sorted((x for x in histogram if x > 0), reverse=True):
            if length > capacity:
                raise ValueError("an item exceeds the capacity")
            self._place(length, histogram[length])
        if histogram.get(0):
            self.segments[0] = [(0, 0, histogram[0])]  # what has no tokens needs no room
            self.containers = max(self.containers, 1)

    def _add(self, size: int, start: int, count: int) -> None:
        if count and size:
            if size not in self.room:
                self.room[size] = []
                insort(self.sizes, size)
            self.room[size].append((start, count))

    def _take(self, length: int) -> tuple[int, int, int] | None:
        """A range of equal containers with the least room that is enough: room, start, count."""
        at = bisect_left(self.sizes, length)
        if at == len(self.sizes):
            return None
        size = self.sizes[at]
        start, count = self.room[size].pop()
        if not self.room[size]:
            del self.room[size]
            self.sizes.pop(at)
        return size, start, count

    def _place(self, length: int, n: int) -> None:
        segments, rank = self.segments.setdefault(length, []), 0
        while n:
            found = self._take(length)
            if found is None:
                size, start, count = self.capacity, self.containers, -(-n // (self.capacity // length))
                self.containers += count
            else:
                size, start, count = found
            each = size // length
            full = min(count, n // each)
            if full:
                segments.append((rank, start, each))
                rank, n = rank + full * each, n - full * each
                self._add(size - each * length, start, full)
            if count > full and n and n < each:
                segments.append((rank, start + full, n))
                self._add(size - n * length, start + full, 1)
                rank, n, full = rank + n, 0, full + 1
            self._add(size, start + full, count - full)


def pieces(lengths: DataFrame, key: str, capacity: int) -> DataFrame:
    """Items: ``key``, ``piece``, ``first_token``, ``n_tokens``; only what exceeds the capacity is split."""
    last = F.greatest(F.lit(0), F.ceil(F.col("n_tokens") / F.lit(capacity)) - 1).cast("bigint")
    p = lengths.select(key, F.col("n_tokens").alias("__all"), F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"))
    first = F.col("piece") * F.lit(capacity)
    return p.select(key, "piece", first.alias("first_token"), F.least(F.lit(capacity).cast("bigint"), F.col("__all") - first).alias("n_tokens"))


def packed(df: DataFrame, key: str, text: str, capacity: int, vocabulary: str | None = None) -> DataFrame:
    """``key``, ``piece``, ``first_token``, ``n_tokens``, ``container_id``: every text assigned exactly once.

    A text of at most ``capacity`` tokens is one piece; a longer one is cut at multiples of the capacity, and its
    pieces are assigned each once. Texts are tokenized once; their counts are written to the shared folder. To the
    driver comes the histogram, at most capacity + 1 rows whatever the data. Ranks within a length are taken in buckets
    of bounded size, so a length that a third of all rows share is no burden. Null and empty texts are pieces of no
    tokens in container 0. Repeated rows are items of their own.
    """
    items = pieces(cut(token_counts(df, key, text, vocabulary)), key, capacity)
    histogram = {r.n_tokens: r.n for r in items.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = Plan(histogram, capacity)
    buckets = max(1, -(-max(histogram.values(), default=0) // RANKED_AT_ONCE))
    sliced = items.withColumn("__bucket", F.pmod(F.xxhash64(key, "piece"), F.lit(buckets)))
    sizes = sliced.groupBy("n_tokens", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("n_tokens").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("n_tokens", "__bucket", F.coalesce(before, F.lit(0)).alias("__before"))
    ranked = sliced.withColumn("__rank", F.row_number().over(Window.partitionBy("n_tokens", "__bucket").orderBy(key, "piece")) - 1)
    ranked = ranked.join(offsets, ["n_tokens", "__bucket"])
    shared = df.sparkSession.sparkContext.broadcast({n: tuple(np.array(x, np.int64) for x in zip(*s)) for n, s in plan.segments.items()})

    @pandas_udf("bigint")
    def slot(length: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.zeros(len(length), np.int64)
        n, r = length.to_numpy(), rank.to_numpy()
        for one in np.unique(n):
            at = n == one
            ranks, starts, each = shared.value[int(one)]
            i = np.searchsorted(ranks, r[at], side="right") - 1
            out[at] = starts[i] + (r[at] - ranks[i]) // each[i]
        return pd.Series(out)

    return ranked.select(key, "piece", "first_token", "n_tokens", slot("n_tokens", F.col("__before") + F.col("__rank")).alias("container_id"))
