"""Exact behaviour of the cleaning operators on small frames."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import sparkscrub as s
from sparkscrub import queries
from sparkscrub.functions import text as fx
from sparkscrub.operators import duplicates
from sparkscrub.operators.duplicates import row_similarity
from sparkscrub.operators.missing import carry
from sparkscrub.plans.order import numbered, ordered
from sparkscrub.plans.stats import MAP_ROWS, modes, quantiles


def values(df, c):
    return [r[0] for r in df.select(c).collect()]


@pytest.fixture(scope="module")
def sample(spark):
    return spark.createDataFrame(
        [("  alice smith ", 25.0, "$50,000", "M", "a@x.com", "US", 4.0), ("Bob", None, "$60,000", "F", None, "UK", 6.0), (None, 999.0, "$70,500", "male", "C@X.COM", "US", 3.0)],
        "name string, age double, income string, gender string, email string, country string, rating double",
    )


def test_standardize_types(spark, sample):
    d = s.DataStandardizer()
    out = d.transform(sample)
    assert dict(out.dtypes)["income"] == "bigint" and values(out, "income") == [50000, 60000, 70500]
    r = d.get_report()
    assert r.loc[r.column == "income", "success_count"].item() == 3


def test_standardize_kinds(spark):
    df = spark.createDataFrame([("Yes", "5%", "2020-1-5", "1.5"), ("no", "7", "03/04/2021", "(500)"), (None, "9 %", "Jan 5, 2020", "2e3")], "b string, p string, d string, n string")
    out = s.DataStandardizer().transform(df)
    assert values(out, "b") == [True, False, None]
    assert values(out, "p") == [0.05, 0.07, 0.09]
    assert [str(v) for v in values(out, "d")] == ["2020-01-05 00:00:00", "2021-03-04 00:00:00", "2020-01-05 00:00:00"]
    assert values(out, "n") == [1.5, None, 2000.0]


def test_standardize_leaves_numbers(spark):
    df = spark.createDataFrame([(1, 2.0)], "x long, y double")
    d = s.DataStandardizer()
    assert d.transform(df).dtypes == df.dtypes and d.get_report().empty


@pytest.mark.parametrize("strategy,filled", [("mean", 2.75), ("median", 3.0), ("zero", 0.0)])
def test_impute_numbers(spark, strategy, filled):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,), (4.0,), (4.0,)], "x double")
    assert values(s.MissingValueHandler(strategies={"x": strategy}).fit_transform(df), "x")[2] == filled


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "x double")
    assert values(s.MissingValueHandler().fit_transform(df), "x") == [1.0, 2.0, 3.0]
    assert s.check_quality(df)["total_missing_values"] == 1


def test_impute_mode_ties_take_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",), ("a",)], "c string")
    assert values(s.MissingValueHandler().fit_transform(df), "c")[2] == "a"


def test_drop_threshold_and_unfitted(spark):
    df = spark.createDataFrame([(1.0, 1), (None, 2), (None, 3), (None, 4), (None, 5)], "x double, y long")
    assert s.MissingValueHandler().fit_transform(df).columns == ["y"]
    with pytest.raises(RuntimeError):
        s.MissingValueHandler().transform(df)


@pytest.mark.parametrize("parts", [1, 5])
@pytest.mark.parametrize("how,want", [("ffill", [None, 1.0, 1.0, 1.0, 4.0, 4.0]), ("bfill", [1.0, 1.0, 4.0, 4.0, 4.0, None]), ("interpolate", [None, 1.0, 2.0, 3.0, 4.0, 4.0])])
def test_carry(spark, how, want, parts):
    df = spark.createDataFrame(list(enumerate([None, 1.0, None, None, 4.0, None])), "i int, x double").repartition(parts)
    assert values(carry(df, "x", how, ["i"]).orderBy("i"), "x") == want


def test_carry_in_source_order(spark):
    df = spark.createDataFrame([(i, None if i % 3 else float(i)) for i in range(60)], "i int, x double").repartition(7).sortWithinPartitions("i")
    df = spark.createDataFrame(df.collect(), df.schema).coalesce(3)
    order = values(df, "i")
    got = dict(carry(df, "x", "ffill").collect())
    last = None
    for i in order:
        last = float(i) if i % 3 == 0 else last
        assert got[i] == last


@pytest.mark.parametrize("how", ["ffill", "bfill", "interpolate"])
def test_long_groups_are_gone_through_once(spark, how):
    """A frame that ends with the group costs the square of the group's rows."""
    n, step = 20_000, 1_000
    df = spark.range(n).select("id", F.lit(0).alias("g"), F.when((F.col("id") % step == 7) & (F.col("id") < n - step), F.col("id").cast("double")).alias("v")).repartition(3)
    out = carry(df, "v", how, ["id"], ["g"])
    assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    last = n - 2 * step + 7
    back = lambda i: (i - 7) // step * step + 7.0 if i >= 7 else None
    want = {
        "ffill": lambda i: min(back(i), last) if i >= 7 else None,
        "bfill": lambda i: None if i > last else 7.0 if i <= 7 else back(i - 1) + step,
        "interpolate": lambda i: None if i < 7 else float(min(i, last)),
    }[how]
    assert {r.id: r.v for r in out.collect()} == {i: want(i) for i in range(n)}


@pytest.mark.parametrize("how", ["ffill", "bfill", "interpolate"])
def test_carry_shuffles_rows_once_and_halves_bounds(spark, how):
    """Gaps go over many buckets; rows are not held against each bound, and go through one shuffle that both ways of use share."""
    n, known = 50_000, (3, 20_000, 49_000)
    out = carry(spark.range(n).select("id", F.when(F.col("id").isin(*known), F.col("id") * 2.0).alias("v")).repartition(3), "v", how, ["id"])
    got = {r.id: r.v for r in out.collect()}
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "lambda" not in plan
    assert len([x for x in plan.splitlines() if "Exchange hashpartitioning(" in x and "ReusedExchange" not in x]) == 1
    before = lambda i: max((k for k in known if k <= i), default=None)
    after = lambda i: min((k for k in known if k >= i), default=None)
    want = {
        "ffill": lambda i: None if before(i) is None else before(i) * 2.0,
        "bfill": lambda i: None if after(i) is None else after(i) * 2.0,
        "interpolate": lambda i: None if i < 3 else min(i, 49_000) * 2.0,
    }[how]
    assert got == {i: want(i) if want(i) is None else pytest.approx(want(i)) for i in range(n)}


@pytest.mark.parametrize("rows", [0, 1, 2, 300])
def test_buckets_count_the_bounds_reached(spark, rows):
    """Any number of bounds, with nulls and NaN among the keys: buckets follow the order, and none is null."""
    df = spark.range(rows).select("id", F.when(F.col("id") % 50 == 7, None).when(F.col("id") % 50 == 9, float("nan")).otherwise(-F.col("id").cast("double")).alias("x"))
    for order in (["x"], ["x", "id"]):
        got = ordered(df, order).df.orderBy(*order, "id").collect()
        assert len(got) == rows and [r["__bucket"] for r in got] == sorted(r["__bucket"] for r in got)


def test_drop_and_fill(spark):
    df = spark.createDataFrame([(1, None, None), (None, "a", None), (None, None, None)], "x long, y string, d date")
    assert s.drop_na(df, how="all", subset=["x", "y"]).count() == 2
    assert s.drop_na(df, axis=1, how="all").columns == ["x", "y"]
    assert s.fill_na(df).collect()[2] == (0, "unknown", None)


def test_exact_duplicates(spark):
    df = spark.createDataFrame([("A", "a@x", 1, None), ("B", "b@x", 2, 1.0), ("A", "a@x", 3, 5.0), ("C", "c@x", 4, 2.0), ("a", "a@x", 5, 1.0)], "name string, email string, age long, score double").coalesce(1)
    h = s.DuplicateHandler()
    assert h.find_exact(df, ["name", "email"]).count() == 1
    out = h.transform(df)
    assert sorted(values(out, "age")) == [2, 3, 4, 5]
    r = h.get_report().iloc[0]
    assert (r.duplicates_found, r.groups, r.rows_before, r.rows_after) == (1, 1, 5, 4)
    assert sorted(values(h.transform(df, "first"), "age")) == [1, 2, 4, 5]
    merged = {r.name: r for r in h.transform(df, "merge").collect()}
    assert merged["A"].age == 3 and merged["A"].score == 5.0


def test_fuzzy_duplicates(spark):
    df = spark.createDataFrame([("John Smith", 1), ("Jon Smith", 2), ("Alice", 3), ("JOHN SMITH", 4)], "name string, n long").coalesce(1)
    h = s.DuplicateHandler()
    assert h.find_fuzzy(df, ["name"], 0.8).count() == 3
    assert sorted(values(h.transform(df, "first"), "n")) == [1, 3]


def greedy(rows, k, threshold):
    """Groups by the definition: (first row, row, score)."""
    out, done = set(), set()
    for i, a in enumerate(rows):
        if i in done:
            continue
        found = [(j, s) for j in range(i + 1, len(rows)) if j not in done and rows[j][0] == a[0] and (s := row_similarity(a[1:], rows[j][1:])) >= threshold]
        done |= {j for j, _ in found}
        if found:
            out |= {(i, i, 1.0)} | {(i, j, round(s, 9)) for j, s in found}
    return out


@pytest.mark.parametrize("piece", [3, 1000])
def test_fuzzy_blocks_of_any_size(spark, piece):
    """One block with most rows, copies, nulls in match columns, and chains of similar rows; in pieces and in one."""
    rng = random.Random(piece)
    names = ["anna berg", "anna bergh", "ana berg", "bernd kohl", "bernt kohl", "carla", None, "", "karla"]
    rows = []
    for i in range(90):
        v = rng.choice(names)
        if v and rng.random() < 0.5:
            at = rng.randrange(len(v))
            v = v[:at] + rng.choice("abcxyz") + v[at + 1 :]
        rows.append(("hot" if i % 4 else rng.choice(["b", None]), v, rng.choice(["x1", "x2", None])))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, b string, m string, w string").repartition(5)
    h = s.DuplicateHandler(order_by=["i"])
    got = h.find_fuzzy(df, ["m", "w"], 0.8, "b", piece_rows=piece)
    ids = {r["__row_id"]: r.i for r in h._ids.collect()}
    found = {(ids[r.group_id], ids[r.row_id], round(r.score, 9)) for r in got.collect()}
    assert found == greedy(rows, 2, 0.8)
    members = {j for g, j, _ in found if g != j}
    assert sorted(values(h.transform(df, "first"), "i")) == [i for i in range(90) if i not in members]
    other = df.where("i < 20")
    assert sorted(values(h.transform(other, "first"), "i")) == [i for i in range(20) if i not in {j for g, j, _ in greedy(rows[:20], 2, 0.8) if g != j}]


def test_rows_of_a_large_block_meet_by_parts_of_cells(spark, monkeypatch):
    """Changed, moved, missing and added characters, cells of several lengths, two blocks, nulls: the same groups, and no piece is compared with another."""
    rng = random.Random(3)
    rows, bases = [], ["".join(rng.choice("abcdeABCDE12") for _ in range(rng.choice([8, 9]))) for _ in range(50)]
    for i in range(260):
        v = rng.choice(bases)
        if rng.random() < 0.5:
            at = rng.randrange(len(v))
            v = v[:at] + rng.choice(["", "7"]) + v[at + rng.randrange(2) :]
        rows.append(("a" if i % 5 else "b", None if i % 41 == 0 else v, rng.choice(["red", "RED", "green", None])))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, b string, m string, w string").repartition(3)
    monkeypatch.setattr(s.DuplicateHandler, "_by_pieces", None)
    for names, threshold in ((["m", "w"], 0.93), (["m"], 0.85)):
        h = s.DuplicateHandler(order_by=["i"])
        got = h.find_fuzzy(df, names, threshold, "b", piece_rows=40)
        ids = {r["__row_id"]: r.i for r in h._ids.collect()}
        found = {(ids[r.group_id], ids[r.row_id], round(r.score, 9)) for r in got.collect()}
        assert found == greedy([r[: 1 + len(names)] for r in rows], len(names), threshold)
        assert len(found) > 50


def test_cells_are_compared_many_at_once(monkeypatch):
    """The same ratios as one by one; short ASCII cells are not compared one by one."""
    rng = random.Random(11)
    for letters, longest in (("ab", 9), ("ab", duplicates.MEET_LENGTH), ("0123456789X", 18), ("abé", 6), ("ab", 230)):
        cells = [None, "", *("".join(rng.choice(letters) for _ in range(rng.randrange(longest + 1))) for _ in range(30))]
        cells += [c and c[2:] + "B" + c[:2] for c in cells]
        x, y = (v.ravel() for v in np.indices((len(cells), len(cells))))
        want = [duplicates.string_similarity(cells[i], cells[j]) for i, j in zip(x, y, strict=True)]
        with monkeypatch.context() as m:
            if "é" not in letters and longest <= duplicates.MEET_LENGTH - 1:
                m.setattr(duplicates, "string_similarity", None)
            assert duplicates._Cells(pa.chunked_array([pa.array(cells, pa.string())])).ratios(x, y).tolist() == want


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_rows_meet_and_are_settled_over_batches(monkeypatch, size):
    """Parts and rows that gather go on over several batches: the same groups as by the definition; teams do not meet."""
    monkeypatch.setattr(duplicates, "MEET_ROWS", size)
    monkeypatch.setattr(duplicates, "MEET_PAIRS", 2)
    rng = random.Random(size)
    rows = [(i % 2, "".join(rng.choice("012") for _ in range(rng.choice([6, 6, 7])))) for i in range(200)]
    frame = pa.table({"team": pa.array([t for t, _ in rows], pa.int64()), "pos": pa.array(range(200), pa.int64()), "m0": [v for _, v in rows], "cell": [v for _, v in rows]})
    parted = duplicates._parted(duplicates._parts([6, 7], 0.8), ["part", "side", "team", "pos", "m0"])
    keys = pa.Table.from_batches(parted(iter(frame.to_batches(max_chunksize=30)))).sort_by([("part", "ascending"), ("pos", "ascending")])
    edges = pa.Table.from_batches(duplicates._met(1, 0.8)(iter(keys.to_batches(max_chunksize=size))))
    got = pa.Table.from_batches(duplicates._settled(iter(edges.sort_by([("a", "ascending"), ("b", "ascending")]).to_batches(max_chunksize=size))))
    want = {(a, b, s) for a, b, s in greedy(rows, 1, 0.8) if a != b}
    found = [(a, b, round(s, 9)) for a, b, s in zip(got["seed"].to_pylist(), got["pos"].to_pylist(), got["score"].to_pylist(), strict=True)]
    assert set(found) == want and len(found) == len(want) > 50


def test_edges_are_settled_in_rounds_and_in_one_task(spark, monkeypatch):
    rng = random.Random(5)
    edges = sorted({tuple(sorted(rng.sample(range(80), 2))) for _ in range(200)})
    want = {}
    for a, b in edges:
        if a not in want:
            want.setdefault(b, a)
    df = spark.createDataFrame([(a, b, 0.9) for a, b in edges], "a long, b long, score double")
    for most in (0, 60, 1000):
        monkeypatch.setattr(duplicates, "TASK_EDGES", most)
        assert {r.pos: r.seed for r in s.DuplicateHandler._by_edges(df).collect()} == want


def test_fuzzy_over_a_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [("", r.c_name, r.c_mktsegment) for r in spark.read.parquet(f"{sf}/customer.parquet").orderBy("c_custkey").collect()]
    keys = [r.c_custkey for r in spark.read.parquet(f"{sf}/customer.parquet").orderBy("c_custkey").collect()]
    got = {(r.seed, r.c_custkey, r.score) for r in queries.QUERIES["dedup_fuzzy_one_block"](spark, sf).collect()}
    assert got == {(keys[a], keys[b], round(x, 4)) for a, b, x in greedy(rows, 2, 0.95)} and got


def test_exact_members(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), (None, 4), (None, 5), ("c", 6)], "k string, v long").coalesce(1)
    got = s.DuplicateHandler().exact_members(df, ["k"]).orderBy("v")
    assert [(r.group_id, r.row_id, r.score, r.v) for r in got.collect()] == [(0, 0, 1.0, 1), (0, 2, 1.0, 3), (1, 3, 1.0, 4), (1, 4, 1.0, 5)]


@pytest.mark.parametrize("rows", [MAP_ROWS - 5, 3 * MAP_ROWS])
def test_quantiles_of_many_rows(spark, rows):
    df = spark.range(rows).select(F.col("id"), (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7.0).alias("x"), (F.col("id") % 3).cast("double").alias("few"), F.lit(4.0).alias("same"), F.lit(None).cast("double").alias("none"))
    shares = [0.0, 0.01, 0.25, 0.5, 0.5000017, 0.99, 1.0]
    names = ["x", "few", "same", "none"]
    got = quantiles(df, {c: (F.col(c), shares) for c in names})
    want = {c: df.agg(F.percentile(c, F.lit(shares))).first()[0] for c in names}
    assert all(got[c] == pytest.approx(want[c], rel=1e-9) for c in names[:3]) and got["none"] is None
    assert modes(df, {"few": F.col("few"), "none": F.col("none")}) == {"few": 0.0, "none": None}


def test_order_by_text_and_constant_columns_is_dealt_out(spark):
    df = spark.range(20_000).select(F.format_string("k%07d", F.col("id")).alias("t"), F.lit(1).alias("one"), F.when(F.col("id") % 7 == 0, F.col("id").cast("double")).alias("v"))
    for order in (["t"], ["one", "t"]):
        sizes = ordered(df, order).df.groupBy("__bucket").count().toPandas()["count"]
        assert len(sizes) > 20 and sizes.max() < 2000
        got = carry(df, "v", "ffill", order).agg(F.count_if(F.col("v") != F.floor(F.substring("t", 2, 9).cast("int") / 7) * 7)).first()[0]
        assert got == 0


def test_row_numbers(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")).repartition(6)
    assert numbered(df, [F.col("x")], "i").where("x <> i").count() == 0


def test_whole_texts_are_normalised(spark):
    import unicodedata

    sf = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.k: r.t for r in queries.QUERIES["text_normalize_unicode"](spark, sf).collect()}
    assert got == {i: t and unicodedata.normalize("NFKD", t) for i, t in text.items()}


def test_outliers(spark):
    df = spark.createDataFrame([(v, 1000 * v) for v in (25, 30, 28, 35, 999, 27, 33, 29, -5, 31)], "age long, income long")
    h = s.OutlierHandler()
    lo, hi = h.detect(df, ["age"])["age"]
    got = values(h.transform(df), "age")
    assert min(got) == lo and max(got) == hi
    assert h.transform(df, "remove").count() == 8
    assert sum(values(h.transform(df, "flag"), "age_is_outlier")) == 2
    assert h.get_report().outlier_count.item() == 2
    with pytest.raises(ValueError):
        h.detect(df, method="none")


def test_no_spread_no_outliers(spark):
    df = spark.createDataFrame([(5.0,)] * 9 + [(50.0,)], "x double")
    h = s.OutlierHandler()
    h.detect(df, method="modified_zscore")
    assert values(h.transform(df), "x")[-1] == 50.0


@pytest.mark.parametrize("f,given,want", [
    (fx.strip_whitespace, "  a \t b\n", "a b"), (fx.titlecase, "o'connor mcdonald-smith 3rd", "O'Connor Mcdonald-Smith 3Rd"), (fx.remove_html, "<p>Hi &amp; bye</p>&lt;b&gt;", "Hi & bye"),
    (fx.remove_urls, "see https://x.y/z now", "see  now"), (fx.remove_accents, "Crème Brûlée é", "Creme Brulee e"), (fx.clean_address, " 12 main St.  apt 3", "12 main street. apartment 3"),
    (fx.clean_email, " A@B.c ", "a@b.c"), (fx.clean_email, "none", None), (fx.clean_phone, "+1 (555) 123-4567", "(555) 123-4567"), (fx.clean_phone, "123", None), (fx.clean_code, " ab c ", "ABC"), (fx.titlecase, None, None),
])
def test_text(spark, f, given, want):
    assert spark.createDataFrame([(given,)], "t string").select(f(F.col("t"))).first()[0] == want


def test_text_report_counts_changes_only(spark):
    df = spark.createDataFrame([(" a",), ("A",), (None,)], "n string")
    c = s.TextCleaner()
    c.clean_names(df, "n")
    assert c.get_report().rows_modified.item() == 1


def test_categories(spark):
    df = spark.createDataFrame([("dev", "M"), ("dev", "male"), ("qa", "F"), ("pm", None), ("dev", "Male")], "job string, g string")
    out = s.CategoryStandardizer(mappings={"g": {"M": "Male", "male": "Male", "F": "Female"}}).transform(df)
    assert set(values(out, "g")) == {"Male", "Female", None}
    c = s.CategoryStandardizer(rare_threshold=2, rare_columns=["job"])
    assert sorted(values(c.transform(df), "job")) == ["Other", "Other", "dev", "dev", "dev"]
    assert c.get_report().rows_modified.item() == 2


def test_quality(spark):
    df = spark.createDataFrame([(1.0, "x"), (None, "y"), (3.0, None)], "a double, b string")
    q = s.check_quality(df)
    assert (q["total_rows"], q["total_missing_values"], q["duplicate_rows"], q["completeness_percentage"]) == (3, 2, 0, 66.67)
    assert values(s.quality_score(df), "quality_category") == ["Good", "Average", "Average"]
    with pytest.raises(TypeError):
        s.check_quality([1])
    susp = s.detect_suspicious(spark.createDataFrame([(150, 20000), (30, 12345)], "age long, income long"))
    assert susp.collect() == [(1, 1), (0, 0)]


def test_pipeline(spark, sample):
    out, report = s.AutomatedCleaner(
        duplicate_subset=["email"], outlier_columns=["age"], column_types={"name": "name", "email": "email"}, scale_method="minmax", extract_date_features=True, add_missing_indicators=True, drop_correlated=True,
    ).clean(sample)
    assert report["validation"]["missing_after"] == 0 and report["validation"]["rows_before"] == 3
    assert "Alice Smith" in values(out, "name")
    r = values(out, "rating") if "rating" in out.columns else [0, 1]
    assert min(r) >= 0 and max(r) <= 1 and not any(math.isnan(v) for v in r)


def test_pipeline_skips(spark, sample):
    out, report = s.AutomatedCleaner(skip_steps=["standardize", "missing"], persist=False).clean(sample)
    assert out.schema == sample.schema and set(report) == {"initial_quality", "final_quality", "validation"}


def test_empty_frames(spark):
    df = spark.createDataFrame([], "x double, t string, d timestamp_ntz")
    out, report = s.AutomatedCleaner(outlier_columns=["x"], duplicate_subset=["t"], scale_method="standard", persist=False).clean(df)
    assert out.count() == 0 and report["validation"]["data_loss_pct"] == 0
