"""The corpus operators against brute force, exact round trips, and at the edges."""

import math
import random
import re
import time
from collections import Counter
from datetime import datetime
from itertools import product

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from catalogq.llm import format_duplicates, leakage, log_sketch, lookalikes, mojibake, packing, plans, survivors
from catalogq.llm.survivors import Bundle, Rule

# --- p1


@pytest.mark.parametrize("error", [0.01, 0.05])
def test_percentiles_keep_their_bound(spark, error):
    rng = random.Random(1)
    values = [rng.choice([0, -1, 1]) * math.exp(rng.uniform(-20, 40)) for _ in range(2000)] + [5.0] * 500 + [None, float("nan"), 5e-324, -1e300]
    df = spark.createDataFrame([("g" if i % 3 else None, v, i % 4) for i, v in enumerate(values)], "g string, v double, s int")
    ps = [0.0, 0.01, 0.5, 0.9, 0.999, 1.0]
    slices = log_sketch.bucket_counts(df, ["g", "s"], "v", error)
    got = log_sketch.percentiles(log_sketch.combined(slices, ["g"]), ["g"], ps, error).collect()
    whole = log_sketch.percentiles(log_sketch.bucket_counts(df, ["g"], "v", error), ["g"], ps, error).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, whole)) and len(got) == 2 * len(ps)
    for r in got:
        mine = sorted(v for i, v in enumerate(values) if ("g" if i % 3 else None) == r.g and v is not None and not math.isnan(v))
        exact = mine[max(1, math.ceil(r.percentile * len(mine))) - 1]
        assert abs(r.estimate - exact) <= abs(exact) * error * 1.000001 and r.n == len(mine)


def test_published_prices_keep_their_bound(spark):
    df = spark.range(1, 3000).select(F.col("id").alias("category1"), F.lit(None).cast("string").alias("category2"), F.col("id").alias("price_raw"))
    got = plans._percentiles(log_sketch.bucket_counts(df, plans.CATEGORIES, "price_raw", plans.BUCKET_ERROR)).where("percentile = 0.5").collect()
    assert len(got) == 2999 and all(abs(r.estimate - r.category1) <= plans.PRICE_ERROR * r.category1 for r in got)


def test_percentile_edges(spark):
    df = spark.createDataFrame([(1, float("inf")), (1, float("-inf")), (1, 0.0), (2, None)], "g int, v double")
    got = log_sketch.percentiles(log_sketch.bucket_counts(df, ["g"], "v", 0.01), ["g"], [0.1, 0.5, 1.0], 0.01)
    assert [(r.g, r.estimate) for r in got.orderBy("percentile").collect()] == [(1, -math.inf), (1, 0.0), (1, math.inf)]
    assert log_sketch.percentiles(log_sketch.bucket_counts(df.where("false"), ["g"], "v", 0.01), ["g"], [0.5], 0.01).count() == 0
    with pytest.raises(ValueError):
        log_sketch.gamma(0)


# --- p3


def brute(bundles):
    def cost(choice):
        rules = range(len(choice[0][2]))
        bad = 0
        for r in rules:
            d = next((c[2][r] for c in choice if c[2][r] is not None), None)
            v = next((c[3][r] for c in choice if c[3][r] is not None), None)
            bad += d is not None and v is not None and d != v
        return (bad, [-sum(c[0][i] for c in choice) for i in range(2)])

    return min(cost(c) for c in product(*bundles)), cost


candidate = st.tuples(st.tuples(st.integers(0, 5), st.integers(0, 1)), st.integers(1, 99), st.sampled_from(["a", "b", None]), st.sampled_from(["a", "b", None]))


@given(st.lists(candidate, min_size=1, max_size=5), st.lists(candidate, min_size=1, max_size=5), st.lists(candidate, min_size=1, max_size=3))
@settings(max_examples=300, deadline=None)
def test_branch_and_bound_is_optimal(a, b, c):
    # rule 0 goes from a to b, rule 1 from b to c
    bundles = [[(t, r, [d, None], [None, None]) for t, r, d, _ in a], [(t, r, [None, d], [v, None]) for t, r, d, v in b], [(t, r, [None, None], [None, v]) for t, r, _, v in c]]
    bundles = [list({x[1]: x for x in b}.values()) for b in bundles]
    rows = survivors.search(bundles)
    best, cost = brute(bundles)
    assert cost([next(x for x in b if x[1] == r) for b, r in zip(bundles, rows)]) == best


BUNDLES = [Bundle("record", (), ("score",), "score"), Bundle("name", ("name",), ("int(name IS NOT NULL)", "score")), Bundle("category", ("cat",), ("score",)), Bundle("shelf", ("shelf",), ("score",))]
RULES = [Rule("shelf", "cat")]


def test_search_is_linear_in_signatures():
    began = time.time()
    left = [((i,), i, [f"x{i}"], [None]) for i in range(1, 2001)]
    right = [((i,), i, [None], [f"y{i}"]) for i in range(1, 2001)]
    assert survivors.search([left, right]) == [2000, 2000] and survivors.search([right, left]) == [2000, 2000]
    assert survivors.search([left, [*right, ((7,), 7, [None], ["x5"])]]) == [5, 7] and time.time() - began < 1


def test_a_hot_id_with_many_signatures(spark):
    rng = random.Random(6)
    rows = [(1, i, None, f"c{rng.randrange(40)}" if i % 9 else None, f"s{rng.randrange(60)}" if i % 7 else None, rng.randrange(4), 0) for i in range(300)]
    rows += [(2 + i, 1000 + i, None, f"c{i % 40}", f"s{i % 60}", 1, 0) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, row bigint, name string, cat string, shelf string, score bigint, day int").repartition(5)
    demand = {}
    for s in {r[4] for r in rows if r[4]}:
        n = Counter(r[3] for r in rows if r[4] == s and r[3] is not None)
        demand[s] = max(n, key=lambda c: (n[c], c))
    hot = [r for r in rows if r[0] == 1]
    cost = lambda shelf, cat: (shelf[4] is not None and cat[3] is not None and demand[shelf[4]] != cat[3], -(shelf[4] is not None) - (cat[3] is not None), -shelf[5] - cat[5], shelf[1], cat[1])
    best = min(cost(a, b) for a in hot for b in hot)
    got = {r.id: r for r in survivors.surviving_rows(df, "id", "row", BUNDLES, RULES).collect()}
    assert (got[1].shelf_row, got[1].category_row) == best[3:] and got[1].candidates == 300 and len(got) == 601


def test_trust_has_no_cap(spark):
    top = 2**63 - 1
    df = spark.createDataFrame([(1, 1, top, 1), (1, 2, top - 1, 9), (2, 3, -1, 1), (2, 4, None, 9), (2, 5, -7, 3), (3, 6, 10**13, 1), (3, 7, 10**12, 5)], "id int, row bigint, rate_count bigint, completeness bigint")
    got = survivors.surviving_rows(df, "id", "row", [Bundle("record", (), ("rate_count", "completeness"), "completeness")], [])
    assert {r.id: r.record_row for r in got.collect()} == {1: 1, 2: 3, 3: 6}


def test_a_bundle_takes_part_in_one_rule(spark):
    df = spark.createDataFrame([(1, 1, "a", "b", "c", 1, 1)], "id int, row bigint, name string, cat string, shelf string, score bigint, day int")
    with pytest.raises(ValueError):
        survivors.surviving_rows(df, "id", "row", BUNDLES, [*RULES, Rule("shelf", "name")])


def test_survivors(spark):
    rows = [(1, 1, "a", "c1", "s1", 5, 1), (1, 2, None, "c2", "s2", 9, 1), (1, 3, None, "c2", None, 9, 1), (2, 4, None, None, None, 0, None), (None, 5, "x", "c1", "s1", 1, 1), (None, 6, "y", "c1", "s1", 1, 1)]
    rows += [(3, 7, "n", "c9", None, 8, 1), (3, 8, None, "c1", None, 1, 1), (3, 9, None, None, "s1", 2, 1)]  # s1 demands c1
    rows += [(4, 20, None, None, "alone", 3, 1), (4, 21, None, "c5", None, 2, 1)]  # a shelf that never has a category
    rows += [(100 + i, 1000 + i, "n", "c1", "s1", 1, 1) for i in range(20)]
    df = spark.createDataFrame(rows, "id int, row bigint, name string, cat string, shelf string, score bigint, day int")
    got = {r.id: r for r in survivors.surviving_rows(df, "id", "row", BUNDLES, RULES).collect()}
    assert (got[1].record_row, got[1].name_row, got[1].category_row, got[1].shelf_row, got[1].candidates) == (2, 1, 2, 2, 3)
    assert (got[2].record_row, got[2].category_row) == (4, 4) and got[None].record_row == 5 and got[None].candidates == 2
    assert (got[3].category_row, got[3].shelf_row) == (8, 9)  # c9 is trusted more, but contradicts the shelf
    df = df.withColumn("candidates", F.lit("clash")).withColumn("record_row", F.lit(None).cast("int"))
    built = {r.id: r for r in survivors.built_records(df, "id", "row", BUNDLES, RULES).collect()}
    assert tuple(built[1][c] for c in ("name", "cat", "shelf")) == ("a", "c2", "s2") and built[3].cat == "c1" and built[2].name is None
    assert (got[4].record_row, got[4].category_row, got[4].shelf_row) == (20, 21, 20)
    assert len(built) == len(got) == 25 and all(v is not None for r in got.values() for c, v in r.asDict().items() if c != "id")
    assert survivors.surviving_rows(df.where("false"), "id", "row", BUNDLES, RULES).count() == 0


# --- p5

words_alphabet = "aAbB ,.!\n‌سی1É"


def test_format_duplicates_match_brute_force(spark):
    rng = random.Random(2)
    texts = [("".join(rng.choice(words_alphabet) for _ in range(rng.randrange(5))), "".join(rng.choice(words_alphabet) for _ in range(rng.randrange(4)))) for _ in range(400)]
    rows = [(i + 1, a if i % 11 else None, b, "clash") for i, (a, b) in enumerate(texts)] + [(1000 + i, "same Text", f"{'.' * (i % 5)}", "x") for i in range(300)] + [(2000, "w " * 200_000, "", "x"), (2001, " w" * 200_000, "!", "x")]
    df = spark.createDataFrame(rows, "row int, a string, b string, digest string")
    key = {r: tuple(sorted(regex.findall(r"[\p{L}\p{Nd}\p{M}‌]+", f"{a}\n{b}".lower()))) for r, a, b, _ in rows if a is not None and b is not None}
    groups = {}
    for r, k in key.items():
        groups.setdefault(k, []).append(r)
    want = {(min(g), r) for g in groups.values() for r in g if r != min(g)}
    got = format_duplicates.format_duplicates(df, ["a", "b"], "row").collect()
    assert {(r.first_row, r.copy_row) for r in got} == want and len(got) == len(want)
    keyed = format_duplicates.keyed_rows(df, ["a", "b"], "row")
    assert {(r.first_row, r.copies) for r in format_duplicates.copy_groups(keyed).collect()} == {(min(g), len(g)) for g in groups.values()}
    assert format_duplicates.collisions(keyed).count() == 0
    assert format_duplicates.format_duplicates(df.where("false"), ["a", "b"], "row").count() == 0


def test_characters_are_made_one(spark):
    df = spark.createDataFrame([(1, "كتاب ۱۲ ＡＢ"), (2, "ab 12 کتاب"), (3, "AB ١٢ كتاب!"), (4, "ab 13 کتاب")], "row int, a string")
    assert sorted((r.first_row, r.copy_row) for r in format_duplicates.format_duplicates(df, ["a"], "row").collect()) == [(1, 2), (1, 3)]


def test_a_collision_keeps_groups_apart(spark):
    df = spark.sql("SELECT 1 AS row, X'00' AS digest, struct(1L AS h, 1 AS l) AS proof UNION ALL SELECT 2, X'00', struct(2L, 1)")
    assert format_duplicates.copy_groups(df).count() == 2 and format_duplicates.collisions(df).first()["forms"] == 2


# --- p7


@pytest.mark.parametrize(
    "odd, plain",
    [("ꓢꓮꓠꓬ", "SANY"), ("ᏢᎻᎥlips", "PHilips"), ("Ꭺ4", "A4"), ("ՏՕLO", "SOLO"), ("cօla", "cola"), ("ɡolf ɑ", "golf a"), ("Ϲasio", "Casio"), ("Ⲣⲟco", "Poco"), ("Ӏd vііі", "ld viii"), ("ΆΒ", "ÁB"), ("хор", "xop"), ("чайник для Тhe дом. Хор", "чайник для The дом. Xop"), ("Ｔｈｅ １２", "The 12"), ("Тhe", "The"), ("Ноmе", "Home"), ("QС-74Н9СX3Q", "QC-74H9CX3Q"), ("Κ", "K"), ("café", "café"), ("a​b⁠c﻿", "abc"), ("a b　c", "a b c"), ("كتاب ي ى", "کتاب ی ی"), ("ﻻﻣپ", "لامپ"), ("می‌‌شود", "می‌شود"), ("‌الف ", "الف "), ("آب", "آب"), ("۱۲٣", "123"), ("­", ""), ("Зимaркa", "Зимарка"), ("ە", "ه"), ("ئ", "ئ")],
)
def test_odd_text(odd, plain):
    assert lookalikes.consistent_form(odd) == plain and lookalikes.consistent_form(plain) == plain


@pytest.mark.parametrize("text", ["Зимарка", "лОДВЕНА", "Ναυτίλιον", "ΝΑΥΤΊΛΙΟΝ", "می‌شود", "café Ñandú", "«سلام»؟", "ok 👍", "👨‍👩‍👧", "a\tb\nc  d!!", "", "رأی، تأیید", "LEDدار", "A-1", "русский хор поёт", "роса на траве и сор", "уха: 2 л", "сор, роса 5 и уха", "Հայաստան օր", "ᏣᎳᎩ ᎦᏬᏂᎯᏍᏗ", "Ναι και Όχι", "10 kV", "чайник Bosch и сор"])
def test_usual_text_stays(text):
    assert lookalikes.consistent_form(text) == text


@given(st.text(alphabet="aАоοΝНсpЗ1é́‌‍﻿يیك ｆﬁ👍️س. ٔا", max_size=12))
@settings(max_examples=500, deadline=None)
def test_form_is_stable(text):
    once = lookalikes.consistent_form(text)
    assert lookalikes.consistent_form(once) == once


def test_mixed_words_without_a_spelling_are_reported(spark):
    df = spark.createDataFrame([(1, "Aя"), (2, "жук Zoo"), (3, "kЖ5s " + "x" * 200_000), (4, "ж5й")], "id int, a string")
    assert sorted(r.source_row for r in lookalikes.odd_values(df, "id", ["a"], "t").collect()) == [1, 3]


def test_odd_values(spark):
    rows = [(1, "Тhe", None), (1, "Тhe", "ok"), (2, "the", "ي"), (3, None, ""), (4, "x" * 300_000 + "​", "سلام")]
    df = spark.createDataFrame(rows, "id int, a string, b string").withColumn("value", F.lit(1)).withColumn("field", F.lit("clash"))
    got = lookalikes.odd_values(df, "id", ["a", "b"], "t").collect()
    assert sorted((r.source_row, r.field) for r in got) == [(1, "a"), (1, "a"), (2, "b"), (4, "a")]
    assert [r[0] for r in df.select(lookalikes.normalized(F.col("a"))).collect()][:4] == ["The", "The", "the", None]
    assert lookalikes.odd_values(df.where("false"), "id", ["a"], "t").count() == 0


# --- p8


@given(st.dictionaries(st.integers(0, 40), st.integers(1, 60), max_size=12))
@settings(max_examples=200, deadline=None)
def test_plan_fits_and_fills(histogram):
    plan = packing.Plan(histogram, 40)
    used = Counter()
    for length, n in histogram.items():
        segments = plan.segments[length]
        ranks = [s[0] for s in segments] + [n]
        assert ranks[0] == 0 and ranks == sorted(ranks)
        for (rank, start, each), end in zip(segments, ranks[1:]):
            for k in range(rank, end):
                used[start + (k - rank) // each] += length
    assert all(u <= 40 for u in used.values()) and all(0 <= c < plan.containers for c in used)
    total = sum(x * n for x, n in histogram.items())
    # one by one best fit for decreasing lengths
    rooms, count = [], 0
    for length in sorted((x for x, n in histogram.items() for _ in range(n) if x), reverse=True):
        fit = min((r for r in rooms if r >= length), default=None)
        if fit is None:
            count += 1
            rooms.append(40 - length)
        else:
            rooms.remove(fit)
            rooms.append(fit - length)
    assert plan.containers <= max(count, 1 if histogram.get(0) else 0) + 1 and plan.containers >= -(-total // 40)


def test_packing_assigns_all_once(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_AT_ONCE", 7)
    texts = [None, "", "word " * 100, "a", "a", "a"] + ["some words here " * (i % 9 + 1) for i in range(200)] + ["long text " * 3000]
    df = spark.createDataFrame([(i if i != 4 else 3, t, 7) for i, t in enumerate(texts)], "doc_id bigint, text string, piece int")
    got = packing.packed(df, "doc_id", "text", 64).collect()
    lengths = Counter((r.doc_id, r.n_tokens) for r in packing.token_counts(df, "doc_id", "text").collect())
    per = {}
    for r in got:
        per.setdefault(r.doc_id, []).append(r)
    for (doc, n), copies in lengths.items():
        mine = sorted(r.piece for r in per[doc])
        assert sum(r.n_tokens for r in per[doc]) == n * copies and len(mine) == copies * max(1, -(-n // 64))
    full = Counter()
    for r in got:
        full[r.container_id] += r.n_tokens
    assert max(full.values()) <= 64 and sum(full.values()) / (64 * len(full)) > 0.9
    assert packing.packed(df.where("false"), "doc_id", "text", 64).count() == 0


# --- p9


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=8), st.lists(st.sampled_from("abc"), max_size=12), st.integers(0, 3))
@settings(max_examples=300, deadline=None)
def test_myers_matches_dynamic_programming(pattern, text, errors):
    bits = {}
    for k, w in enumerate(pattern):
        bits[w] = bits.get(w, 0) | 1 << k
    want = {e: d for e in range(1, len(text) + 1) if (d := min(edit(pattern, text[s:e]) for s in range(e + 1))) <= errors}
    assert dict(leakage.myers(bits, len(pattern), text, errors)) == want


@pytest.mark.parametrize("errors", [0, 1, 2])
def test_leaks_match_brute_force(spark, errors):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(10, 30)))) for i in range(12)] + [(50, "short item"), (51, None), (52, "")]
    docs = []
    for d in range(60):
        ws = rng.choices(vocabulary, k=rng.randrange(0, 30))
        src = rng.choice(items[:12])[1].split()
        cut = rng.randrange(len(src))
        piece = [w if rng.random() > 0.07 else "zz" for w in src[cut : cut + rng.randrange(8, 22)]]
        docs.append((d, ", ".join([*ws, *piece, *rng.choices(vocabulary, k=5)]).upper(), "clash"))
    docs += [(100, None, ""), (101, "", ""), (102, "x " * 100_000 + items[0][1], ""), (0, docs[0][1], "")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    it = spark.createDataFrame(items, "item_id bigint, text string")
    want = set()
    for d, t, _ in docs:
        ws = leakage.words(t or "")
        for i, x in items:
            xs = leakage.words(x or "")
            for s in range(len(xs) - 12):
                bits = {}
                for k, w in enumerate(xs[s : s + 13]):
                    bits[w] = bits.get(w, 0) | 1 << k
                for _, e in leakage.myers(bits, 13, ws, errors):
                    want.add((d, i))
    for size in (1 << 20, 40):
        got = leakage.leaks(df, it, errors=errors, pass_chars=size).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert leakage.leaks(df, it.where("false")).count() == 0 and leakage.leaks(df.where("false"), it).count() == 0


def test_leaks_do_not_depend_on_blocks(spark):
    ws = [f"w{i}" for i in range(60)]
    a, b = " ".join(ws[:30]), " ".join(ws[30:])
    near = " ".join([*ws[:5], "zz", *ws[6:13]])
    it = spark.createDataFrame([(1, a), (1, b), (2, a), (2, a)], "item_id bigint, text string").coalesce(1)
    df = spark.createDataFrame([(7, a), (7, "x " + a), (8, b), (9, near), (10, "nothing of it")], "doc_id bigint, text string")
    for errors, more in ((0, set()), (1, {(9, 1, 1), (9, 2, 1)})):
        got = [sorted(map(tuple, leakage.leaks(df, it, errors=errors, pass_chars=n).collect())) for n in (1, 100, 1 << 20)]
        assert got[0] == got[1] == got[2] and set(got[0]) == {(7, 1, 0), (7, 2, 0), (8, 1, 0)} | more and len(got[0]) == len(set(got[0]))


# --- p10

PERSIAN = "برای اطمینان، اگر چرخ ماهیگیری را در انبار می‌گذارید، از پنبه به عنوان زیرانداز استفاده کنید؛ قیمت: 20 تومان."
FRENCH = "La finition a été contrôlée à l’atelier. Très bien conçu, mais un peu bruyant près de la fenêtre."


def lossless(text, *steps):
    for codec in steps:
        raw = text.encode("utf-8")
        text = "".join(bytes([b]).decode(codec) if _known(b, codec) else chr(b) for b in raw)
    return text


def _known(b, codec):
    try:
        bytes([b]).decode(codec)
        return True
    except UnicodeDecodeError:
        return False


@pytest.mark.parametrize("text", [PERSIAN, FRENCH])
@pytest.mark.parametrize("steps", [("latin-1",), ("cp1252",), ("cp1251",), ("cp1256",), ("cp437",), ("cp850",), ("mac_roman",), ("cp1252", "cp1252"), ("latin-1", "latin-1")])
def test_garbled_text_comes_back(text, steps):
    sound = "متن سالم پیش از آن. "
    got, n, how = mojibake.restore(sound + lossless(text, *steps))
    assert got == sound + text and n and how


@pytest.mark.parametrize("codec", ["cp1252", "cp1251"])
def test_single_byte_persian_comes_back(codec):
    raw = PERSIAN.replace("ی", "ي").encode("cp1256")
    garbled = "".join(bytes([b]).decode(codec) if _known(b, codec) else chr(b) for b in raw)
    assert mojibake.restore(garbled)[0] == PERSIAN


@pytest.mark.parametrize("text", [PERSIAN, FRENCH, "عکس تک، خط؛ شرط… طرح؟ «حفظ» غ، آگهی", "ATENÇÃO: a função é simples; NÃO lavar. «MAÇÃ»", "Зимарка и Лодвена", "Ναυτίλιον", "naïve décor 40 °C – ok… “x”", "", "what?? ???", "ÂGE conseillé", "طط غغ"])
def test_sound_text_is_no_case(text):
    assert mojibake.restore(text) == (text, 0, "")


SINGLE = "".join(bytes([b]).decode("cp1252") if _known(b, "cp1252") else chr(b) for b in PERSIAN.replace("ی", "ي").encode("cp1256"))


@pytest.mark.parametrize(
    "garbled, sound",
    [
        (f"{lossless(PERSIAN, 'cp1251')}\n{lossless(PERSIAN, 'cp437')}", f"{PERSIAN}\n{PERSIAN}"),
        (f"{lossless(PERSIAN, 'cp1251')}\n{lossless(FRENCH, 'mac_roman')}", f"{PERSIAN}\n{FRENCH}"),
        (f"{lossless(PERSIAN, 'cp437')}\n{SINGLE}", f"{PERSIAN}\n{PERSIAN}"),
        (lossless(PERSIAN, *["cp1252"] * 6), PERSIAN),
    ],
)
def test_all_passages_come_back(garbled, sound):
    got, n, _ = mojibake.restore(garbled)
    assert got == sound and n > 1 and mojibake.restore(sound) == (sound, 0, "")


def test_letters_beside_a_single_byte_passage_are_no_utf8():
    got = mojibake.restore(lossless(PERSIAN, "cp437") + "\n" + SINGLE + "\nббКГЯПЎ text")[0]
    assert got.startswith(f"{PERSIAN}\n{PERSIAN}\n") and "Ѻ" not in got and "ϡ" not in got


def test_prefilter_keeps_what_restore_changes():
    patterns = [re.compile(p) for p in mojibake.SUSPECT]
    dropped = set()
    for view in mojibake.VIEWS:
        back = {}
        for c, b in mojibake.to_byte(view).items():
            back.setdefault(b, c)
        for code in [*range(0xA0, 0x250), *range(0x370, 0x500), *range(0x621, 0x6D4), *range(0x1E00, 0x1F00), *range(0x2010, 0x2028), 0x20AC, 0x1F600]:
            if all(b in back for b in chr(code).encode()):
                garbled = "".join(back[b] for b in chr(code).encode())
                for text in (f"one {garbled} two", f"one{garbled}two", f"one{garbled} two", f"one {garbled}two"):
                    if not any(p.search(text) for p in patterns) and mojibake.restore(text)[1]:
                        dropped.add((view, garbled[0]))
    assert dropped <= {("mac", c) for c in "…\xa0–—“”‘’"}  # a quote or dash before one letter, as in sound text


def test_prefilter_in_the_jvm(spark):
    texts = ["Produto excelente, você pode comprar sem medo.", "La fenêtre et la tête", "même", "Êtes-vous prêt ?"]
    df = spark.createDataFrame(list(enumerate(lossless(t, "cp1256") for t in texts)), "doc_id int, text string")
    assert {r.doc_id: r.restored for r in mojibake.garbled_documents(df).collect()} == dict(enumerate(texts))


def test_garbled_documents(spark):
    bad = lossless(PERSIAN, "cp1252")
    rows = [(1, PERSIAN), (2, bad), (2, bad), (3, None), (4, ""), (5, "lost � here"), (6, "سلام " * 50_000 + bad), (7, FRENCH)]
    df = spark.createDataFrame([(i, t, "clash", datetime(2024, 1, 1)) for i, t in rows], "doc_id bigint, text string, restored string, passages timestamp")
    got = mojibake.garbled_documents(df).collect()
    assert sorted(r.doc_id for r in got) == [2, 2, 5, 6]
    assert {r.doc_id: r.restored for r in got}[6].endswith(PERSIAN) and {r.doc_id: r.how for r in got}[5] == "lost"
    assert mojibake.garbled_documents(df.where("false")).count() == 0


def test_survivors_match_brute_force(spark):
    rng = random.Random(5)
    pick = lambda xs: rng.choice(xs)
    rows = [(rng.randrange(70), i, pick(["n", None]), pick(["c1", "c2", "c3", None]), pick(["s1", "s2", "s3", None]), rng.randrange(6), rng.randrange(3)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, row bigint, name string, cat string, shelf string, score bigint, day int").repartition(6)
    demand = {}
    for s in ("s1", "s2", "s3"):
        n = Counter(r[3] for r in rows if r[4] == s and r[3] is not None)
        demand[s] = max(n, key=lambda c: (n[c], c))
    got = {r.id: r for r in survivors.surviving_rows(df, "id", "row", BUNDLES, RULES).collect()}
    assert len(got) == len({r[0] for r in rows})
    for key, r in got.items():
        mine = [x for x in rows if x[0] == key]
        by = {x[1]: x for x in mine}
        assert r.candidates == len(mine) and r.record_row == min(mine, key=lambda x: (-x[5], x[1]))[1]
        assert r.name_row == min(mine, key=lambda x: (-(x[2] is not None), -x[5], x[1]))[1]

        def cost(cat, shelf):
            bad = shelf[4] is not None and cat[3] is not None and demand[shelf[4]] != cat[3]
            return (bad, -((cat[3] is not None) + (shelf[4] is not None)), -(cat[5] + shelf[5]))

        assert cost(by[r.category_row], by[r.shelf_row]) == min(cost(a, b) for a in mine for b in mine)
