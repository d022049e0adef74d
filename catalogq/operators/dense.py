"""Per-key figures over heavily skewed keys by dense accumulator arrays.

Each input split dictionary-encodes its keys and adds its rows into dense arrays with numpy (bincount, scatter-reduce); what
leaves a split is one array entry per distinct key, however many rows the key has. The arrays are cut into blocks by the
key's hash, each block goes to a task of its own, and there the arrays of all splits are added one after the other
as they arrive. So a key that owns a third of all rows costs the reduce side one entry per split like any other key, and
what a task holds is bounded by the keys of its block, not by the number of splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MIN = np.iinfo(np.int64).min
#: Distinct keys a split keeps before it sends what it has; bounds the memory of a task.
FLUSH = 1_000_000
#: Distinct keys a block should hold; more keys make more blocks.
BLOCK_KEYS = 250_000


class _Accumulator:
    """Dense arrays over a dictionary of keys: row counts, and per measure the non-null count and its sum or maximum.

    Arrays of single batches are kept side by side and added up when they have doubled.
    """

    def __init__(self, ops: list[str]):
        self.ops, self.parts, self.size, self.settled = ops, [], 0, 0

    def add(self, keys: pa.Array, blocks: np.ndarray, n: np.ndarray, seen: list[np.ndarray], value: list[np.ndarray]) -> None:
        """Adds arrays; their keys may repeat."""
        self.parts.append((keys, blocks, n, seen, value))
        self.size += len(keys)
        if self.size > 2 * self.settled + 65_536:
            self.settle()

    def settle(self) -> None:
        """Leaves one entry per key."""
        if len(self.parts) < 1:
            return
        keys = pa.concat_arrays([p[0] for p in self.parts])
        codes, dictionary = _encoded(keys)
        size, first = len(dictionary), _first(codes, len(dictionary))
        joined = lambda of: np.concatenate([of(p) for p in self.parts])
        seen = [_summed(codes, joined(lambda p: p[3][i]), size) for i in range(len(self.ops))]
        value = [_reduced(op, codes, joined(lambda p: p[4][i]), size) for i, op in enumerate(self.ops)]
        self.parts = [(dictionary, joined(lambda p: p[1])[first], _summed(codes, joined(lambda p: p[2]), size), seen, value)]
        self.size = self.settled = size

    def add_rows(self, batch: pa.RecordBatch) -> None:
        codes, dictionary = _encoded(batch.column(0))
        size, seen, value = len(dictionary), [], []
        for i, op in enumerate(self.ops):
            col = batch.column(2 + i)
            there = col.is_valid().to_numpy(zero_copy_only=False)
            v, c = col.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[there], codes[there]
            seen.append(np.bincount(c, minlength=size).astype(np.int64))
            value.append(_reduced(op, c, v, size))
        blocks = batch.column(1).to_numpy(zero_copy_only=False)[_first(codes, size)]
        self.add(dictionary, blocks, np.bincount(codes, minlength=size).astype(np.int64), seen, value)

    def chunks(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """The arrays cut by block, one row a block."""
        self.settle()
        if not self.size:
            return
        ((keys, blocks, n, seen, value),) = self.parts
        order = np.argsort(blocks, kind="stable")
        cuts = np.flatnonzero(np.diff(blocks[order])) + 1
        offsets = pa.array(np.concatenate([[0], cuts, [len(order)]]), pa.int32())
        listed = lambda a: pa.ListArray.from_arrays(offsets, a)
        arrays = [pa.array(blocks[order][np.concatenate([[0], cuts])], pa.int32()), listed(keys.take(pa.array(order)))]
        arrays += [listed(pa.array(a[order])) for a in (n, *seen, *value)]
        whole = pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema)], schema=schema)
        for at in range(0, len(whole), 1024):
            yield whole.slice(at, 1024)


def _encoded(keys: pa.Array) -> tuple[np.ndarray, pa.Array]:
    e = keys.dictionary_encode(null_encoding="encode")
    return e.indices.to_numpy(zero_copy_only=False).astype(np.int64), e.dictionary


def _first(codes: np.ndarray, size: int) -> np.ndarray:
    first = np.zeros(size, np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    return first


def _summed(codes: np.ndarray, v: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)  # bincount adds as floats, which are exact for counts of one batch only
    np.add.at(out, codes, v)
    return out


def _reduced(op: str, codes: np.ndarray, v: np.ndarray, size: int) -> np.ndarray:
    if op == "sum":
        return _summed(codes, v, size)
    out = np.full(size, _MIN, np.int64)
    np.maximum.at(out, codes, v)
    return out


def dense_key_figures(
    df: DataFrame,
    key: str,
    measures: dict[str, tuple[str, Column]],
    blocks: int | None = None,
) -> DataFrame:
    """One row per value of ``key``: ``n`` rows and, per measure, ``<name>_n`` non-null values and ``<name>``.

    ``measures`` maps a name to ("sum" | "max", column); columns are taken as bigint, sums wrap as bigint does.
    ``blocks`` is the number of array blocks, each a task; by default as many as there are shuffle partitions, or more where
    the keys, counted roughly in a pass over their column alone, would make blocks of more than BLOCK_KEYS. The key may
    have any type that can be dictionary-encoded. A null key is a key of its own, a key without a non-null value has
    a null ``<name>`` and ``<name>_n`` 0, and an empty table gives no rows. Other columns do not matter; a key column
    named ``n`` makes the row count ``n_rows``.
    """
    rows_name = "n_rows" if key == "n" else "n"
    spark = df.sparkSession
    ops = [op for op, _ in measures.values()]
    if bad := set(ops) - {"sum", "max"}:
        raise ValueError(f"unknown measure: {sorted(bad)}")
    if blocks is None:
        distinct = df.agg(F.approx_count_distinct(key)).first()[0]
        blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-distinct // BLOCK_KEYS))
    kind = df.schema[key].dataType
    rows = df.select(
        F.col(key).alias("key"),
        F.pmod(F.xxhash64(F.col(key)), F.lit(blocks)).cast("int").alias("block"),
        *[c.cast("bigint").alias(f"m{i}") for i, (_, c) in enumerate(measures.values())],
    )
    longs = T.ArrayType(T.LongType())
    arrays = ["n", *(f"seen{i}" for i in range(len(ops))), *(f"value{i}" for i in range(len(ops)))]
    schema = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("keys", T.ArrayType(kind)), *(T.StructField(a, longs) for a in arrays)])
    names = list(measures)
    out_schema = T.StructType([T.StructField(key, kind), T.StructField(rows_name, T.LongType()), *(f for name in names for f in (T.StructField(f"{name}_n", T.LongType()), T.StructField(name, T.LongType())))])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, acc = to_arrow_schema(schema), _Accumulator(ops)
        for batch in batches:
            if batch.num_rows:
                acc.add_rows(batch)
            if acc.settled > FLUSH:
                yield from acc.chunks(arrow)
                acc = _Accumulator(ops)
        yield from acc.chunks(arrow)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        acc, k = _Accumulator(ops), len(ops)
        for batch in batches:
            if batch.num_rows:
                flat = [batch.column(1 + i).flatten() for i in range(2 + 2 * k)]
                n, *rest = [a.to_numpy(zero_copy_only=False) for a in flat[1:]]
                acc.add(flat[0], np.zeros(len(n), np.int64), n, rest[:k], rest[k:])
        acc.settle()
        if acc.size:
            ((keys, _, n, seen, value),) = acc.parts
            columns = [keys, pa.array(n)]
            for s, v in zip(seen, value):
                columns += [pa.array(s), pa.array(v, mask=s == 0)]
            arrow = to_arrow_schema(out_schema)
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return rows.mapInArrow(split, schema).repartitionById(blocks, F.col("block")).mapInArrow(added, out_schema)
