"""Operators of the catalogue engine on small fixtures, and the four runs end to end."""

import csv
import hashlib
import io
import json
import os
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from catalogq import pipelines, schemas
from catalogq.functions import digest
from catalogq.cli import main
from catalogq.operators import canonical, dedup, profile, quantile, scopes
from catalogq.operators import transforms as T
from catalogq.plans import catalogue
from catalogq.sources import exact_csv, publish, sniff, split_csv

PRODUCT = dict(zip(T.PRODUCT_COLUMNS, ["1", "محصول یک", "80", "10", "دسته یک", "دسته دو", "برند", "100", "فروشنده یک", "False", "90", "test"]))
COMMENT = dict(zip(T.COMMENT_COLUMNS, ["1", "عنوان", "متن نظر", "23 تیر 1395", "4", "recommended", "True", "1", "خوب", "", "2", "0", "فروشنده", "001A", ""]))


def write(path, columns, base, changes, bom=True, end="\n"):
    with open(path, "w", encoding="utf-8-sig" if bom else "utf-8", newline="") as f:
        w = csv.writer(f, lineterminator=end)
        w.writerow(columns)
        w.writerows([[{**base, **c}[k] for k in columns] for c in changes])
    return str(path)


def test_exact_tokens(spark, tmp_path):
    rows = [{"title_fa": 'a ""b"\r\nc', "Seller": "NA"}, {"title_fa": "  ", "Brand": "null", "id": ""}]
    path = write(tmp_path / "p.csv", T.PRODUCT_COLUMNS, PRODUCT, rows, end="\r\n")
    got = exact_csv.read_exact_csv(spark, path, T.PRODUCT_COLUMNS).orderBy("source_row").collect()
    assert [r.source_row for r in got] == [2, 3]
    assert [r.title_fa for r in got] == ['a ""b"\r\nc', "  "] and got[0].Seller == "NA" and got[1].Brand == "null" and got[1].id == ""
    assert exact_csv.read_exact_csv(spark, path, T.PRODUCT_COLUMNS, max_rows=1).count() == 1


@pytest.mark.parametrize("text", ["a,b\n1,2\n", "b,a,c\n", "a,b,c\n1,2\n", "a,b,c\n1,2,3,4\n", 'a,b,c\n1,"2"x,3\n', 'a,b,c\n1,"2,3\n', "", "a,b,c\n1," + "x" * 50 + ",2\n"])
def test_broken_files(text):
    with pytest.raises(exact_csv.CsvError):
        list(exact_csv.exact_rows(iter(text.splitlines(keepends=True)), ["a", "b", "c"], limit=40))


LINES = st.lists(st.sampled_from(['1,a,b', '2,"x\ny",z', '3,a"b,c', '4,"p""q",', ',,', '', '5,"\n\n,\n""",r', '6,"a\rb",c', 'س,"،\n",é', '7,"",""']), max_size=25)


@given(LINES, st.sampled_from(["\n", "\r\n"]), st.booleans(), st.booleans(), st.integers(1, 40))
@settings(max_examples=300, deadline=None)
def test_pieces_hold_the_records_of_the_whole(tmp_path_factory, lines, end, bom, closed, size):
    """Every way of cutting a file gives the row numbers and first records that reading it in one go gives."""
    text = end.join(["a,b,c", *lines]) + end * closed
    path = tmp_path_factory.mktemp("cut") / "x.csv"
    path.write_bytes((b"\xef\xbb\xbf" if bom else b"") + text.encode())
    with open(path, encoding="utf-8-sig", newline="") as f:
        want = [r for r in csv.reader(f, strict=True) if r]
    number, quoted, got, data = 0, False, [], path.read_bytes()
    for no in range(-(-len(data) // size)):
        a, b = split_csv._piece(str(path), no, size)
        piece = data[a:b].removeprefix(b"\xef\xbb\xbf") if no == 0 else data[a:b]
        s = split_csv.scan(piece, quoted)
        if s.records:
            got.append((number, next(r for r in csv.reader(io.StringIO((piece[s.first :] + data[b:]).decode(), newline=""), strict=True) if r)))
        number, quoted = number + s.records, s.quoted
    assert number == len(want) and got == [(n, want[n]) for n, _ in got]


def test_cut_files_read_as_whole_ones(spark, tmp_path, monkeypatch):
    rows = [{"title_fa": 'a ""b"\r\nc, "' * (i % 3), "Seller": f"s{i}\n" * (i % 4), "id": str(i)} for i in range(200)]
    path = write(tmp_path / "p.csv", T.PRODUCT_COLUMNS, PRODUCT, rows, end="\r\n")
    whole = sorted(map(tuple, exact_csv.read_exact_csv(spark, path, T.PRODUCT_COLUMNS).collect()))
    monkeypatch.setattr(split_csv, "PIECE", 5000)
    assert len(split_csv.plan(spark, [path], 5000)) > 3
    assert sorted(map(tuple, exact_csv.read_exact_csv(spark, path, T.PRODUCT_COLUMNS).collect())) == whole and len(whole) == 200
    bad = tmp_path / "bad.csv"
    bad.write_text("a,b\n" + "1,2\n" * 3000 + "1,2,3\n")
    with pytest.raises(Exception, match="row 3002 has 3 fields"):
        exact_csv.read_exact_csv(spark, str(bad), ["a", "b"]).count()
    lone = tmp_path / "lone.csv"
    lone.write_bytes(b"a,b\r" + b"1,2\r" * 3000)
    assert split_csv.plan(spark, [str(lone)], 5000) is None and exact_csv.read_exact_csv(spark, str(lone), ["a", "b"]).count() == 3000


def test_sniffing(tmp_path):
    assert sniff.encoding_of("﻿سلام".encode("utf-8")) == "utf-8-sig" and sniff.encoding_of("سلام".encode()[:-1]) == "utf-8-sig"
    assert sniff.encoding_of("سلام".encode("cp1256")) == "cp1256"
    p = tmp_path / "x.csv"
    p.write_text("id;title;Price\n1;a;2\n")
    assert sniff.sniff(str(p)) == ("utf-8-sig", ";")
    assert sniff.dataset_kind("x", ["id", "Price"]) == "products" and sniff.dataset_kind("x", ["product_id", "body"]) == "comments"
    assert sniff.find_column(["ID", "Rate"], ["score", "rate"]) == "Rate"


def test_split_csv(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_text('a,b\n1,\n"",x\n')
    assert sorted(tuple(r) for r in exact_csv.read_split_csv(spark, str(p), ["a", "b"]).collect()) == [("", "x"), ("1", "")]


def test_duplicates_are_equal_columns_not_hashes(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, None, "a"), (4, "a", "")], "row int, x string, y string")
    assert sorted((r.row, r.copies) for r in dedup.first_of_equal(df, ["x", "y"], "row").collect()) == [(1, 2), (3, 1), (4, 1)]
    assert dedup.duplicate_id_figures(df, "x").first().asDict() == {"rows": 3, "distinct_ids": 1, "repeated_ids": 1, "excess_rows": 2}
    assert dedup.duplicate_id_figures(df.where("false"), "x").first().asDict() == {"rows": 0, "distinct_ids": 0, "repeated_ids": 0, "excess_rows": 0}
    assert dedup.variation(df, "x", {"y": [F.col("y")]}).first()[0] == 1


def test_canonical_order(spark):
    rows = [(1, 5, "a", None), (1, 6, "b", 3), (1, 7, "c", 3), (2, 8, "a", None), (2, 9, "a", None), (None, 10, "x", 1)]
    df = spark.createDataFrame(rows, "id int, row bigint, x string, score bigint")
    rank = [canonical.descending(F.col("score")), F.col("row")]
    won = {r.id: (r.row, r.variants) for r in canonical.canonical(df, "id", ["x"], rank).collect()}
    assert won == {1: (6, 3), 2: (8, 1), None: (10, 1)}
    lost = canonical.conflicts(df, "id", "row", ["x"], rank)
    assert sorted((r.row, r.canonical_row, r.selected) for r in lost.collect()) == [(5, 6, False), (6, 6, True), (7, 6, False)]


def test_nearest_rank_of_1001(spark):
    df = spark.createDataFrame([(p,) for p in [*range(1, 1002), None]], "p bigint")
    r = quantile.nearest_rank(df, [], "p", [999]).first()
    assert (r.n, r["rank"], r.threshold) == (1001, 1000, 1000)
    assert quantile.above_threshold(df, "p", 999, "high").where("high").count() == 1
    assert quantile.above_threshold(df.where("p IS NULL"), "p", 999, "high").where("high").count() == 0


def test_ranks_of_any_values(spark):
    values = [float("-inf"), -1e300, -7.0, -7.0, -0.5, 0.0, 0.3, 0.3, 1.0, 1e17, 2e17, float("inf"), float("nan"), None]
    df = spark.createDataFrame([(g, v) for g in ("a", None) for v in values], "g string, v double")
    got = quantile.nearest_rank(df, ["g"], "v", list(range(0, 1001, 40))).collect()
    there = values[:-1]
    assert len(got) == 52 and all(r.n == 13 and (r.threshold == there[r["rank"] - 1] or r["rank"] == 13) and r["rank"] == max(1, -(-r.per_mille * 13 // 1000)) for r in got)
    assert quantile.nearest_rank(df.where("false"), ["g"], "v", [500]).count() == 0


def test_interpolation(spark):
    for values in ([5], [1, 2], [1, 2, 2, 9], list(range(100))):
        df = spark.createDataFrame([("g", v) for v in values], "g string, v bigint")
        r = quantile.interpolated_quantiles(df, ["g"], "v", {"a": 0.05, "b": 0.5, "c": 0.95}).first()
        for name, p in (("a", Fraction(1, 20)), ("b", Fraction(1, 2)), ("c", Fraction(19, 20))):
            at = (len(values) - 1) * p
            low = int(at)
            want = values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (at - low)
            assert r[name] == pytest.approx(float(want))


def test_inventory(spark):
    products = spark.createDataFrame([(1, "Care", "Sun", "A"), (2, "Care", "Sun", None), (3, "Care", None, "B"), (4, None, "Sun", "C")], "product_id bigint, category1 string, category2 string, brand string")
    offers = spark.createDataFrame([(1, 100), (1, 200), (2, 190), (3, None), (9, 5)], "product_id bigint, price bigint")
    comments = spark.createDataFrame([(1, "x", True, 4.0), (2, "y", True, 0.0), (1, None, None, None), (9, "z", True, 1.0)], "product_id bigint, body string, is_buyer boolean, rate double")
    inv = scopes.inventory(products, offers, comments, ["category1", "category2"])
    by = {(r.level, r.scope_category1, r.scope_category2): r for r in inv.collect()}
    assert set(by) == {(1, "Care", None), (2, "Care", "Sun")}
    sun = by[2, "Care", "Sun"]
    assert (sun.products, sun.comments, sun.commented_products, sun.bodies, sun.buyers, sun.ratings, sun.priced_products, sun.price_p50, sun.brands) == (2, 3, 2, 2, 2, 1, 2, 145.0, 1)
    assert scopes.broken_invariants(inv).count() == 0 and by[1, "Care", None].products == 3


def test_profiles(spark):
    df = spark.createDataFrame([(1, "5", "a"), (2, " ", "b"), (3, "x", "b"), (4, "-1", "a"), (5, "0", None)], "row bigint, p string, c string")
    by = {r["column"]: r for r in profile.column_profile(df, ["p", "c"]).collect()}
    assert (by["p"].missing, by["p"].numeric, by["p"].not_numeric, by["p"].least) == (1, 3, 1, -1.0) and by["c"].missing == 1
    assert [(r.value, r.n) for r in profile.top_values(df, ["c"], "row", 1).collect()] == [("a", 2)]
    assert profile.number_classes(df, "p").first().asDict() == {"missing": 1, "zero": 1, "negative": 1, "positive": 1, "not_numeric": 1}
    assert profile.distribution(df, ["p", "c"], 3).select("column").distinct().count() == 1


def test_clean_products(spark, tmp_path):
    c = [{}, {}, {"Seller": "b", "Price": "200"}, {"id": "2"}, {"id": "2", "Rate_cnt": "20", "title_fa": "y"}, {"id": "5", "Price": "bad"}, {"id": "6", "Rate": "101"}, {"id": "7", "Price": "0", "Seller": "nan", "min_price_last_month": "0"}]
    path = write(tmp_path / "p.csv", T.PRODUCT_COLUMNS, PRODUCT, c)
    audit = pipelines.clean_products(spark, path, str(tmp_path / "out"))
    n = audit["rows"]
    assert [n[c] for c in ("input_rows", "exact_duplicate_rows_removed", "distinct_raw_rows_retained", "product_quarantine_rows", "offer_transform_quarantine_rows", "offers_without_canonical_product")] == [8, 1, 7, 1, 1, 1]
    rules = audit["rule_event_counts"]
    assert {k: v for k, v in rules.items() if v} == {"RAW-001": 8, "PRD-001": 1, "ID-001": 7, "BOOL-001": 7, "PRD-002": 2, "PRD-003": 1, "PRD-004": 1, "OFF-001": 1, "OFF-002": 1, "OFF-003": 1, "OFF-004": 1, "OFF-006": 3, "OFF-007": 1, "OFF-009": 1}
    products = spark.read.parquet(f"{tmp_path}/out/products_clean").orderBy("product_id").collect()
    assert [(r.product_id, r.canonical_source_row_number, r.core_attribute_conflict) for r in products] == [(1, 2, False), (2, 6, True), (5, 7, False), (7, 9, False)]
    offers = spark.read.parquet(f"{tmp_path}/out/offers_clean").orderBy("source_row_number").collect()
    assert [(r.product_id, r.price_raw, str(r.price_toman), r.seller) for r in offers] == [(1, 100, "10.0", "فروشنده یک"), (1, 200, "20.0", "b"), (2, 100, "10.0", "فروشنده یک"), (7, None, "None", "nan")]
    quarantined = {(r.dataset, r.entity_id): r.rule_ids for t in ("product", "offer") for r in spark.read.parquet(f"{tmp_path}/out/{t}_quarantine").collect()}
    audits = spark.read.parquet(f"{tmp_path}/out/row_audit").collect()
    assert [(r.source_row_number, r.rule_id, r.action, r.severity, r.is_lossy) for r in audits] == [(7, "OFF-004", "quarantine offer", "error", True), (8, "PRD-004", "quarantine product candidate", "error", True), (9, "OFF-003", "set zero price to null and flag", "warning", True)]
    core = json.loads(spark.read.parquet(f"{tmp_path}/out/product_conflicts").where("candidate_source_row_number = 6").first().raw_core_json)
    assert core["title_fa"] == "y" and set(core) == set(T.CORE_COLUMNS)
    assert quarantined == {("products", 6): ["PRD-004"], ("offers", 5): ["OFF-004"], ("offers", 6): ["OFF-009"]}
    assert (tmp_path / "out/_SUCCESS").read_text() == "success\n" and json.loads((tmp_path / "out/run_manifest.json").read_text())["run_id"]
    assert spark.read.parquet(f"{tmp_path}/out/offers_clean").schema.fieldNames() == schemas.schema(schemas.OFFERS).fieldNames()
    with pytest.raises(FileExistsError):
        pipelines.clean_products(spark, path, str(tmp_path / "out"))

    comments = [{}, {}, {"id": "2", "rate": "3.500"}, {"id": "3", "product_id": "99"}, {"id": "4", "created_at": "31 مهر 1399"}, {"id": "5", "body": "nan"}, {"id": "5", "body": "other"}]
    source = write(tmp_path / "c.csv", T.COMMENT_COLUMNS, COMMENT, comments)
    audit = pipelines.clean_comments(spark, source, f"{tmp_path}/out/products_clean", str(tmp_path / "com"))
    clean = spark.read.parquet(f"{tmp_path}/com/comments_clean").orderBy("comment_id").collect()
    assert [(r.comment_id, r.comment_id_conflict, r.invalid_rate, r.canonical_source_row_number) for r in clean] == [(1, False, False, 2), (2, False, True, 4), (5, True, False, 8)]
    assert audit["rows"]["orphan_comment_rows"] == 1 and audit["rule_event_counts"]["COM-021"] == 1 and audit["rule_event_counts"]["COM-016"] == 1
    assert audit["rows"]["conflict_alternative_count"] == 2 and audit["field_quality_counts"]["body_sentinel_to_null"] == 1 and audit["accepted_date_range"]["jalali_min"] == "1395-04-23"
    lost = spark.read.parquet(f"{tmp_path}/com/comment_conflicts").collect()
    assert len(lost) == 2 and json.loads(lost[0].raw_mapped_json).keys() == set(T.COMMENT_COLUMNS[1:]) and {r.completeness for r in lost} == {11, 12}
    assert {(r.entity_id, tuple(r.rule_ids), r.reason) for r in spark.read.parquet(f"{tmp_path}/com/comment_quarantine").collect()} == {(3, ("JOIN-002",), pipelines.NO_PRODUCT["JOIN-002"]), (4, ("DATE-003",), "DATE-003: quarantine comment (invalid day for Jalali month and year)")}
    inv = pipelines.category_inventory(spark, f"{tmp_path}/out/products_clean", f"{tmp_path}/out/offers_clean", spark.read.parquet(f"{tmp_path}/com/comments_clean"), str(tmp_path / "inv"))
    with pytest.raises(pipelines.ReconciliationError):
        pipelines.category_inventory(spark, f"{tmp_path}/out/products_clean", f"{tmp_path}/out/offers_clean", spark.read.parquet(f"{tmp_path}/com/comments_clean"), str(tmp_path / "inv2"), expected=({"category1": "دسته یک", "category2": None}, {"products": 99}))
    assert not (tmp_path / "inv2").exists()
    assert inv.count() == 2 and b"\r" not in (tmp_path / "inv/inventory.csv").read_bytes()


@pytest.mark.parametrize("phase", ["after_ingest", "after_canonical", "before_completion", "after_rename"])
def test_a_failed_run_leaves_what_was(spark, tmp_path, phase):
    path = write(tmp_path / "p.csv", T.PRODUCT_COLUMNS, PRODUCT, [{}])
    target = tmp_path / "out"
    target.mkdir()
    (target / "old").write_text("kept")

    def fail(at):
        if at == phase:
            raise RuntimeError(at)

    with pytest.raises(RuntimeError):
        pipelines.clean_products(spark, path, str(target), force=True, failure_injector=fail)
    assert sorted(os.listdir(tmp_path)) == ["out", "p.csv"] and (target / "old").read_text() == "kept"


def test_versions_for_stores_without_renames(spark, tmp_path):
    path, target = write(tmp_path / "p.csv", T.PRODUCT_COLUMNS, PRODUCT, [{}]), f"file://{tmp_path}/store"
    assert publish.current(spark, target) is None
    pipelines.clean_products(spark, path, target)
    first = publish.current(spark, target)
    assert spark.read.parquet(f"{first}/products_clean").count() == 1 and os.path.exists(first.removeprefix("file://") + "/_SUCCESS")
    with pytest.raises(FileExistsError):
        pipelines.clean_products(spark, path, target)

    def fail(at):
        if at == "before_completion":
            raise RuntimeError(at)

    with pytest.raises(RuntimeError):
        pipelines.clean_products(spark, path, target, force=True, failure_injector=fail)
    assert publish.current(spark, target) == first and os.listdir(tmp_path / "store/runs") == [first.rpartition("/")[2]]
    pipelines.clean_products(spark, path, target, force=True)
    second = publish.current(spark, target)
    assert second != first and os.listdir(tmp_path / "store/runs") == [second.rpartition("/")[2]]


def test_profile_run(spark, tmp_path):
    p = tmp_path / "products.csv"
    p.write_text("id;title;Price;Rate\n1;a;10;50\n1;b;bad;101\n;c;0;-1\n3;NA;-5;\n3;NA;-5;\n")
    assert main(["profile", "--input", str(p), "--output", str(tmp_path / "o")]) == 0
    r = pipelines.read_report(f"{tmp_path}/o/dataset_profile.json")["datasets"][0]
    v = r["validation"]
    assert (r["rows"], r["delimiter"], r["dataset_type"], v["Rate"]["outside_0_100_count"], v["id"]["exact_full_row_duplicate_count"]) == (5, ";", "products", 2, 1)
    assert v["Price"] == {"missing_count": 0, "zero_count": 1, "negative_count": 2, "non_numeric_count": 1} and v["id"]["duplicated_unique_id_count"] == 2 and v["Rate"]["distribution"] == {"50": 1, "101": 1, "-1": 1}
    assert r["numeric_statistics"]["Price"] == {"min": -5.0, "max": 10.0, "mean": 0.0} and v["product_offer_variation"]["product_ids_with_different_prices"] == 1
    c = tmp_path / "comments.csv"
    c.write_text("product_id,rate,is_buyer\n1,5,True\n9,4,False\n8\n")
    both = pipelines.profile_files(spark, [str(p), str(c)])
    assert both["join_validation"]["orphan_comment_count"] == 2 and both["join_validation"]["orphan_product_ids_sample"] == ["8", "9"]
    assert both["datasets"][1]["validation"]["is_buyer"]["distribution"] == {"True": 1, "False": 1} and pipelines.profile_file(spark, str(c), 2)["rows"] == 2
    assert pipelines.read_report(str(tmp_path / "none")) is None


def test_key_universe(spark, tmp_path):
    for rows in ([(1,), (1,)], [(1,), (None,)], []):
        path = str(tmp_path / f"k{len(rows)}{rows == [(1,), (1,)]}")
        spark.createDataFrame(rows, "product_id bigint").write.parquet(path)
        with pytest.raises(ValueError):
            publish.read_key_universe(spark, path, "product_id")


def test_first_arrivals_stream(spark, tmp_path):
    from catalogq.streaming.first_arrivals import first_arrivals

    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) AS ts, id % 3 AS k FROM range(9)")
    rows.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = first_arrivals(s, ["k"], "ts", "1 hour").writeStream.format("memory").queryName("arrived").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("arrived").count() == 3


def test_samples_and_named_scopes(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else None if i % 2 else "cold", 1) for i in range(300)], "row bigint, s string, n int")
    got = profile.stratified_sample(df, ["s"], "row", 4)
    assert sorted((r.s or "", r["count"]) for r in got.groupBy("s").count().collect()) == [("", 4), ("cold", 4), ("hot", 4)]
    assert got.exceptAll(profile.stratified_sample(df.repartition(7), ["s"], "row", 4)).count() == 0
    inv = spark.createDataFrame([("a", None, 3), ("a", "b", 2)], "scope_x string, scope_y string, products int")
    assert [(r.place, r.products) for r in scopes.named_scopes(inv, [("a", "b"), ("z", None), ("a", None)], ["x", "y"]).orderBy("place").collect()] == [(0, 2), (2, 3)]
    assert scopes.unmet(inv, {"x": "a", "y": None}, {"products": 3}) == {} and scopes.unmet(inv, {"x": "a", "y": "b"}, {"products": 3}) == {"products": (3, 2)}
    assert scopes.unmet(inv, {"x": "q", "y": None}, {"products": 3}) == {"products": (3, None)}
    forms = profile.lexical_classes(spark.createDataFrame([("1",), ("1.5",), ("",), (None,), ("-2",), ("bad",), ("1 x",)], "c string"), "c")
    assert {r.form: r.n for r in forms.collect()} == {"integer": 1, "decimal": 1, "blank": 2, "signed": 1, "letters": 1, "other": 1}


def test_digests_of_known_rows(spark):
    """Frames and field orders against values made by hand from the stated rules."""
    raw = dict(zip(T.PRODUCT_COLUMNS, ["17", "t", "0", "0", "c1", "", "b", "1200", "فروشگاه", "False", "0", " "]))
    df = spark.createDataFrame([(2, *raw.values())], "source_row bigint, " + ", ".join(f"{c} string" for c in T.PRODUCT_COLUMNS))
    frame = lambda tag, b: tag + len(b).to_bytes(8, "big") + b
    offer = b"".join(frame(b"V", x.encode()) for x in ("17", "فروشگاه", "1200", "False", "0"))
    got = df.select(digest.text_fingerprint([F.col(c) for c in T.OFFER_CONTENT])).first()[0]
    assert got == hashlib.sha256(offer).hexdigest() == "d6c38cd50883b43ce6ebeeed1da56f66c07e65fe8e9b466ebdd5bd0e5c7c4fac"
    core = frame(b"S", b"t") + frame(b"S", b"c1") + frame(b"N", b"") + frame(b"S", b"b") + frame(b"N", b"") + frame(b"I", b"0") + frame(b"N", b"")
    assert T.product_candidates(df).select(T.core_digest()).first()[0] == hashlib.sha256(core).hexdigest() == "f56678f1cdd00a055379c67290d33b3f4ff5a74a30ac73ae5b9f018fc5beaf52"


def test_ties_of_comments_fall_to_the_digest(spark, monkeypatch):
    def of(r):
        out = b""
        for c in T.COMMENT_COLUMNS[1:]:
            blank = r[c].strip() == "" or r[c] == "nan" and c in T.SENTINEL_RULES
            b = b"" if blank else r[c].encode()
            out += (b"N" if blank else b"S") + len(b).to_bytes(8, "big") + b
        return hashlib.sha256(out).hexdigest()

    # ids 1 to 12 have two contents of one completeness each, ids 21 to 32 one content with two spellings of a rate
    rows = [COMMENT | {"id": str(i), "body": f"{t}{i}"} for i in range(1, 13) for t in "ab"] + [COMMENT | {"id": str(i), "body": f"c{i}", "rate": t} for i in range(21, 33) for t in ("3.5", " 3.5 ")]
    rows += [COMMENT | {"id": "40", "title": " "}, COMMENT | {"id": "40", "title": "nan"}]
    want, plain = {}, {}
    for n, r in enumerate(rows, 2):
        want[int(r["id"])] = min(want.get(int(r["id"]), ("~",)), (of(r), n))
        plain.setdefault(int(r["id"]), n)
    want = {k: n for k, (_, n) in want.items()}
    assert {k for k in want if want[k] != plain[k]} & set(range(1, 13)) and {k for k in want if want[k] != plain[k]} & set(range(21, 33)) and want[40] == plain[40]

    raw = spark.createDataFrame([(n, *[r[c] for c in T.COMMENT_COLUMNS]) for n, r in enumerate(rows, 2)], "source_row bigint, " + ", ".join(f"{c} string" for c in T.COMMENT_COLUMNS))
    monkeypatch.setattr(catalogue, "raw_comments", lambda spark, d: raw)
    assert {r.comment_id: r.canonical_source_row for r in catalogue.canonical_comments(spark, "").collect()} == want
    assert {r.comment_id: r.canonical_row for r in catalogue.comment_conflicts(spark, "").collect()} == {k: want[k] for k in range(1, 13)}
