"""Dense key figures, orphans, recovering CSV, keyed joins: against brute force and at the edges."""

from collections import defaultdict
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from catalogq.operators import csv_recover as R
from catalogq.operators import dense
from catalogq.operators.keyed import attach_keyed
from catalogq.operators.orphans import orphan_counts, orphan_rows, reference_status


def figures(df, key="k", **kw):
    got = dense.dense_key_figures(df, key, {"total": ("sum", F.col("v")), "top": ("max", F.col("v"))}, **kw)
    return {r[key]: (r.n, r.total_n, r.total, r.top) for r in got.collect()}


@pytest.mark.parametrize("blocks", [7, 1, None])
def test_dense_figures_match_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(dense, "BLOCK_KEYS", 3)
    rows = [("hot" if i % 3 == 0 else f"k{i % 50}" if i % 7 else None, None if i % 5 == 0 else i - 500, i) for i in range(3000)]
    want = defaultdict(list)
    for k, v, _ in rows:
        want[k].append(v)
    df = spark.createDataFrame(rows, "k string, v bigint, n int").repartition(5)
    expect = {k: (len(vs), len(x := [v for v in vs if v is not None]), sum(x) if x else None, max(x, default=None)) for k, vs in want.items()}
    assert figures(df, blocks=blocks) == expect
    big = df.withColumn("v", F.lit((1 << 53) + 1))
    assert figures(big)["hot"] == (1000, 1000, 1000 * ((1 << 53) + 1), (1 << 53) + 1)


def test_dense_figures_flush(spark, monkeypatch):
    rows = [(i % 900 if i % 4 else None, i) for i in range(4000)]
    df = spark.createDataFrame(rows, "k bigint, v bigint").repartition(2)
    acc = dense._Accumulator(["sum"])
    for i in range(30):  # many batches over the same keys stay one entry a key
        acc.add(pa.array(range(5000)), np.zeros(5000, np.int64), np.ones(5000, np.int64), [np.ones(5000, np.int64)], [np.ones(5000, np.int64)])
    acc.settle()
    assert acc.size == 5000 and acc.parts[0][2].tolist() == [30] * 5000
    got = figures(df)
    assert len(got) == len({k for k, _ in rows}) and sum(g[0] for g in got.values()) == 4000 and got[None][2] == sum(range(0, 4000, 4))


def test_dense_figures_edges(spark):
    df = spark.createDataFrame([(None, None), (1, None), (1, None)], "k bigint, v bigint")
    assert figures(df) == {None: (1, 0, None, None), 1: (2, 0, None, None)}
    assert figures(df.where("false")) == {}
    assert dense.dense_key_figures(df.withColumnRenamed("k", "n"), "n", {}).columns == ["n", "n_rows"]
    with pytest.raises(ValueError):
        dense.dense_key_figures(df, "k", {"m": ("mean", F.col("v"))})


def test_keyed_join_keeps_all_rows(spark):
    rows = spark.createDataFrame([(i % 10 if i > 600 else 0, i) for i in range(900)] + [(None, -1)], "k int, x int")
    per = rows.groupBy("k").agg(F.count("*").alias("w"))
    for hot in (1, 3, 100):
        got = attach_keyed(rows, per, ["k"], "w", hot_keys=hot)
        assert got.count() == 901 and got.where("k IS NULL AND w = 1").count() == 1
        assert attach_keyed(rows, per, ["k"], "w", keep=F.col("w") > 100, hot_keys=hot).count() == 630
    assert attach_keyed(rows.where("false"), per, ["k"], "w").count() == 0
    assert attach_keyed(rows, per, ["k"], "w").count() == 901
    with pytest.raises(ValueError):
        attach_keyed(rows.withColumn("w", F.lit(1)), per, ["k"], "w")


REFS = [(1, "a", 10), (1, None, 11), (None, "b", 12), (None, None, 13), (2, "a", 14), (3, None, 15), (1, "a", 16), (None, "z", 17)]
TARGETS = [(1, "a", "extra"), (2, "b", None), (None, "z", None), (1, "a", "again")]


@pytest.mark.parametrize("match, rows", [("simple", {14}), ("partial", {14, 15}), ("full", {11, 12, 14, 15, 17})])
def test_orphans_by_null_mask(spark, match, rows):
    refs = spark.createDataFrame(REFS, "a int, b string, source_row int").withColumn("ref_rows", F.lit("clash")).withColumn("is_orphan", F.lit(None).cast("int"))
    targets = spark.createDataFrame(TARGETS, "a int, b string, source_row string")
    pairs = [("a", "a"), ("b", "b")]
    assert {r.source_row for r in orphan_rows(refs, targets, pairs, match).collect()} == rows
    assert orphan_rows(refs.where("false"), targets, pairs, match).count() == 0
    months = orphan_counts(refs, targets, pairs, "t", F.lit("2024-01"), match)
    assert sum(r.orphans for r in months.collect()) == len(rows)
    none = reference_status(refs, targets.where("false"), pairs, match).where("is_orphan")
    assert none.count() == {"simple": 2, "partial": 6, "full": 6}[match]
    with pytest.raises(ValueError):
        reference_status(refs, targets, pairs, "fuzzy")


def kind(text, n=3, whole=True):
    return R.parse_record(text, 0, n, whole=whole).kind


def test_record_grammar():
    assert R.parse_record('1,"a ""b"", c\nd",', 0, 3, whole=True).fields == ["1", 'a "b", c\nd', ""]
    assert kind("1,a,b") is None and kind("1,a,b\n") is None and kind('"","",""') is None
    assert kind('1,a"b,c') == kind('1,"a"b,c') == kind('1,"a,c') == kind('1, "a",c') == kind('1,"a" ,c') == "quoting"
    assert kind("1,a") == kind("1,a,b,c") == kind("") == kind("1,a\n,b") == "columns"
    assert kind("1,a,b\n" * 5000) == "columns" and kind("1,a,b\n" * 5000 + '"') == "quoting"


@given(st.lists(st.text(alphabet='ab,"\n س', max_size=6), min_size=2, max_size=5))
@settings(max_examples=200, deadline=None)
def test_records_round_trip(fields):
    text = ",".join('"' + f.replace('"', '""') + '"' for f in fields)
    r = R.parse_record(text, 0, len(fields), whole=True)
    assert r.kind is None and r.fields == fields


def test_recovery_at_anchors():
    text = '1,a,b\n2,"broken,x\n3,c,d\nno id,e,f\n4,"g\n5,h",i\n6,j\n7,k,l'
    got = list(R.parse_text(text, 3))
    assert [r.fields[0] for r in got if r.kind is None] == ["1", "3", "no id", "4", "7"]
    assert [(r.kind, r.error_at) for r in got if r.kind] == [("quoting", text.index('g\n5')), ("columns", text.index("6,j") + 3)]
    met = '1,"b,x\n2,c,d\n3,e,f\n4,g"\n5,h,i'  # two stray quotes that close each other
    assert [r.fields[0] for r in R.parse_text(met, 3) if r.kind is None] == ["2", "3", "5"]
    assert list(R.parse_text("", 3)) == [] and list(R.parse_text("\n\n", 3)) == []


def test_parse_records_edges(spark):
    long = '1,"' + "x" * 300_000 + '",2'
    rows = [(1, "1,a,b", datetime(2024, 1, 1)), (2, None, None), (3, "", None), (4, long, None), (4, long, None), (5, '1,"a,b', None)]
    df = spark.createDataFrame(rows, "id int, t string, extra timestamp")
    got = R.parse_records(df, "t", F.lit(3), ["id"]).collect()
    assert sorted((r.id, r.kind) for r in got if r.kind) == [(2, "columns"), (3, "columns"), (5, "quoting")]
    assert sum(len(r.fields[1]) == 300_000 for r in got if r.id == 4) == 2
    assert R.parse_records(df.where("false"), "t", F.lit(3), ["id"]).count() == 0
    many = spark.createDataFrame([("f", '1,a,b\n2,"x\n3,c,d')], "path string, t string")
    got = R.parse_records(many, "t", F.lit(3), ["path"], one_record=False).orderBy("record_no").collect()
    assert [(r.kind, r.error_line) for r in got] == [(None, None), ("quoting", 2), (None, None)] and got[1].broken_text == '2,"x\n'
    clash = R.parse_records(df.withColumnRenamed("id", "kind"), "t", F.lit(3), ["kind"])
    assert sorted((r.kind_kept, r.kind) for r in clash.collect() if r.kind) == [(2, "columns"), (3, "columns"), (5, "quoting")]


@pytest.mark.parametrize("token, ok", [("", True), ("0", True), ("5", True), ("5.00", True), (" 4 ", True), ("4.", True), ("5.5", False), ("3.500", False), ("45", False), ("4,5", False), ("-1", False), ("NaN", False)])
def test_rate_tokens(spark, token, ok):
    assert spark.createDataFrame([(token,)], "x string").select(R.valid_rate(F.col("x"))).first()[0] is ok


def test_count_tokens(spark):
    tokens = {"": True, "007": True, " 3 ": True, "9223372036854775807": True, "0009223372036854775807": True, "9223372036854775808": False, "1 2": False, "1,0": False, "-1": False, "۳": False}
    df = spark.createDataFrame([(t,) for t in tokens], "x string")
    assert [r[0] for r in df.select(R.valid_count(F.col("x"), True)).collect()] == list(tokens.values())
    assert [r[0] for r in df.select(R.valid_count(F.col("x"), False)).collect()][0] is False
