"""Features, schema, sources, streams and command lines."""

import math
import pathlib
import random
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

import sparkscrub as s
from sparkscrub import cli
from sparkscrub.operators.schema import smallest_int_label
from sparkscrub.plans.scratch import drop_scratch, scratch, written
from sparkscrub.streaming import clean_stream


def column(df, c):
    return [r[0] for r in df.select(c).collect()]


def test_standard_scaling(spark):
    df = spark.createDataFrame([(float(v), "b") for v in (1, 2, 3, 4, 5)], "a double, b string")
    v = column(s.FeatureScaler(auto_transform=False).fit_transform(df), "a")
    assert abs(sum(v)) < 1e-9 and abs(sum(x * x for x in v) / 5 - 1) < 1e-9


def test_skewed_column_is_transformed(spark):
    rng = random.Random(42)
    df = spark.createDataFrame([(math.exp(rng.gauss(0, 1)),) for _ in range(100)], "x double")
    t = s.NumericalTransformer().fit(df)
    assert t.model["x"].transform in ("log", "boxcox") and abs(t.model["x"].lam) < 0.3
    assert abs(sum(column(t.transform(df), "x"))) < 1e-6


def test_constant_and_short_columns(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, None)], "c double, e double")
    assert column(s.NumericalTransformer().fit_transform(df), "c") == [0.0, 0.0]


def test_dates(spark):
    df = spark.sql("SELECT * FROM VALUES (timestamp_ntz'2024-01-06 10:00:00'), (timestamp_ntz'2024-04-30'), (timestamp_ntz'2024-07-01'), (NULL) AS t(d)")
    out = s.DateFeatureExtractor(["year", "weekday", "flags", "is_month_end", "season", "month_sin"]).transform(df)
    assert column(out, "d_season") == ["Winter", "Spring", "Summer", None]
    assert column(out, "d_is_weekend") == [1, 0, 0, 0] and column(out, "d_is_month_end") == [0, 1, 0, 0] and column(out, "d_weekday")[0] == 5
    assert "d_month_cos" in out.columns
    assert "d_month_cos" not in s.DateFeatureExtractor(["month_cos"]).transform(df).columns


def test_selection(spark):
    df = spark.createDataFrame([(1, 2, 5, 1), (2, 4, 3, 1), (3, 6, 9, 1), (4, 8, 1, 1)], "a long, b long, c long, k long")
    sel = s.FeatureSelector()
    assert sel.fit_transform(df).columns == ["a", "c"]
    assert dict(zip(sel.get_report().column, sel.get_report().reason, strict=True)) == {"k": "low_variance", "b": "high_correlation"}


def test_indicator(spark):
    df = spark.createDataFrame([(1.0, "x"), (None, "y")], "a double, b string")
    assert s.MissingIndicator().fit_transform(df).columns == ["a", "b", "a_is_missing"]


def test_overview_counts_null_as_value(spark):
    o = s.dataset_overview(spark.createDataFrame([(1.0, "a"), (None, "b"), (3.0, None)], "x double, y string")).set_index("column")
    assert o.loc["x", "missing_pct"] == 33.33 and o.loc["y", "unique_count"] == 3


def test_schema(spark):
    df = spark.createDataFrame([(1, 0.5, "a", 123456789.123), (200, 1.5, "a", 0.1)], "i long, f double, c string, g double")
    assert s.analyze_optimization(df) == {"uint8": ["i"], "float32": ["f", "g"], "category": ["c"]}
    out = dict(s.optimize_dataset(df).dtypes)
    assert out == {"i": "smallint", "f": "float", "c": "string", "g": "double"}
    assert [smallest_int_label(*r) for r in ((0, 255), (0, 256), (-1, 127), (-129, 0), (None, None))] == ["uint8", "uint16", "int8", "int16", "int64"]
    a, b, pct = s.optimization_report(df, s.optimize_dataset(df), {}, False)
    assert a > b and pct > 0


def test_csv_round_trip(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('id,name,price,ok\n1,"a, b",1.5,true\n2,NA,,false\n3\n')
    df = s.load_dataset(str(path), spark=spark)
    assert dict(df.dtypes) == {"id": "bigint", "name": "string", "price": "double", "ok": "boolean"}
    assert df.collect() == [(1, "a, b", 1.5, True), (2, None, None, False), (3, None, None, None)]
    typed = s.load_dataset(str(path), type_map={"float64": ["id"], "int64": ["name"]}, spark=spark)
    assert dict(typed.dtypes)["id"] == "double" and dict(typed.dtypes)["name"] == "string"
    for _ in range(2):
        assert s.load_dataset(str(path), cache=True, cache_dir=str(tmp_path / "c"), spark=spark).count() == 3
    out = s.convert_to_parquet_optimized(str(path), str(tmp_path / "o.parquet"), "gzip", spark=spark)
    assert dict(spark.read.parquet(out).dtypes)["id"] == "smallint"
    path.write_text("a,b\n1,2\n1,2,3\n4\n")
    assert sorted(spark.read.parquet(s.convert_to_parquet(str(path), str(tmp_path / "p.parquet"), spark=spark)).collect(), key=str) == [(1, 2), (4, None)]
    assert s.estimate_csv_memory(str(path), spark=spark) == pytest.approx(path.stat().st_size / 2**20)
    for bad in (lambda: s.load_dataset("x.json", spark=spark), lambda: s.load_dataset(str(path), engine="dask", spark=spark), lambda: s.convert_to_parquet(str(path), "o", engine="x")):
        with pytest.raises(ValueError):
            bad()


def test_csv_cells_over_lines(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('a,b\n1,"two\nlines"\n2,"say ""hi"", twice\n\nover"\n3,plain\n')
    want = [(1, "two\nlines"), (2, 'say "hi", twice\n\nover'), (3, "plain")]
    assert s.load_csv(str(path), spark=spark).collect() == want == s.load_csv(str(path), multi_line=True, spark=spark).collect()
    assert sorted(spark.read.parquet(s.convert_to_parquet(str(path), str(tmp_path / "q.parquet"), spark=spark)).collect()) == want
    assert sorted(map(tuple, spark.read.parquet(s.convert_to_parquet_optimized(str(path), str(tmp_path / "r.parquet"), spark=spark)).collect())) == want


def test_csv_in_chunks(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("a,b\n" + "".join(f"{i},x{i}\n" for i in range(1005)))
    parts = [p.collect() for p in s.load_csv(str(path), chunksize=250, spark=spark)]
    assert [len(p) for p in parts] == [250] * 4 + [5] and [r.a for p in parts for r in p] == list(range(1005))
    assert s.load_csv_polars(str(path), spark=spark).count() == 1005


def test_logging(caplog):
    assert s.get_logger() is None
    s.log(None, "not said")
    with caplog.at_level("INFO"):
        s.log(s.get_logger(enabled=True), "said")
    assert [r.message for r in caplog.records] == ["said"]


def test_cli(spark, tmp_path, capsys):
    path = tmp_path / "t.csv"
    path.write_text("a,b\n1,x\n2,y\n")
    assert cli.optimize_main([str(path), "--to-parquet", str(tmp_path / "o.parquet"), "--optimize"]) == 0
    assert cli.profile_main([str(path), "--sample", "1"]) == 0
    assert "1 rows, 2 columns" in capsys.readouterr().out


def test_scratch_tables_go(spark):
    df = written(spark.range(10), "kept")
    beside = scratch(spark, "beside") + ".csv"
    spark.range(3).write.csv(beside)
    paths = [pathlib.Path(urlparse(p).path) for p in (df.inputFiles()[0], beside)]
    assert df.count() == 10 and all(p.exists() for p in paths)
    drop_scratch()
    assert not any(p.exists() for p in paths)
    assert written(spark.range(4), "again").count() == 4


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    train = spark.createDataFrame([(1.0,), (None,), (3.0,)], "x double")
    train.write.parquet(src)
    model = s.MissingValueHandler().fit(train)
    q = clean_stream(spark.readStream.schema("x double").parquet(src), [model.transform], str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("x").orderBy("x")
    assert column(got, "x") == [1.0, 2.0, 3.0]


def test_partitions_do_not_matter(spark):
    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 7).alias("g"), F.when(F.col("id") % 5 > 0, F.col("id") * 1.5).alias("v"))
    one, many = df.coalesce(1), df.repartition(8)
    for run in (lambda d: s.MissingValueHandler().fit_transform(d), lambda d: s.FeatureScaler(auto_transform=False).fit_transform(d), lambda d: (lambda h: (h.detect(d, threshold=0.1), h.transform(d))[1])(s.OutlierHandler())):
        a, b = ({r["key"]: r for r in run(d.withColumn("key", F.col("k").cast("string"))).collect()} for d in (one, many))
        keyed = lambda rows: sorted((r["key"], None if r["v"] is None else round(float(r["v"]), 6)) for r in rows.values())
        assert keyed(a) == keyed(b)
