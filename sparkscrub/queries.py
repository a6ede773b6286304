"""Catalogue: one query per operator over the standard tables, and SQL that gives the same rows.

The tables are clean, so queries make dirt with expressions that Spark and the SQL share.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import redirect_stdout
from io import StringIO
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import sparkscrub as s
from sparkscrub.cli import optimize_main, profile_main
from sparkscrub.functions import text as fx
from sparkscrub.functions.missing import numeric_columns
from sparkscrub.operators.features import Fitted, boxcox, yeojohnson
from sparkscrub.operators.base import table
from sparkscrub.operators.missing import carry
from sparkscrub.operators.schema import detect_engine, narrow_types
from sparkscrub.plans.scratch import scratch
from sparkscrub.sources import io

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class View:
    """Some expressions over a table, as a Spark frame and as SQL."""

    def __init__(self, table: str, *exprs: str, where: str = ""):
        self.table, self.exprs, self.where = table, exprs, where

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.read.parquet(f"{sf_dir}/{self.table}.parquet")
        return (df.where(self.where) if self.where else df).selectExpr(*self.exprs)

    @property
    def sql(self) -> str:
        return f"SELECT {', '.join(self.exprs)} FROM {self.table}" + (f" WHERE {self.where}" if self.where else "")


def add(name: str, view: View, run: Callable[[DataFrame], DataFrame], sql: str | None) -> None:
    """Register a query over a view; its SQL sees the view as ``d``."""
    QUERIES[name] = lambda spark, sf_dir: run(view.df(spark, sf_dir))
    if sql is not None:
        ORACLES[name] = f"WITH d AS ({view.sql}){',' if sql.lstrip().startswith('+') else ''} {sql.lstrip().removeprefix('+')}"


def rows(spark: SparkSession, data: list[tuple], schema: str) -> DataFrame:
    """A report as a frame."""
    return spark.createDataFrame(data, schema)


def rounded(df: DataFrame, *names: str, to: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), to) for n in names})


# outliers ------------------------------------------------------------------------------------------

OUT = View("lineitem", "l_orderkey", "l_linenumber", "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_extendedprice END AS price", "CASE WHEN l_orderkey % 9 = 0 THEN l_quantity * 40 ELSE l_quantity END AS qty")
BOUNDS = {
    "iqr": ("+q AS (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM d)", "a - 0.5 * (b - a)", "b + 0.5 * (b - a)", 0.5),
    "zscore": ("+q AS (SELECT avg({c}) AS a, stddev_samp({c}) AS b FROM d)", "a - 1.5 * b", "a + 1.5 * b", 1.5),
    "modified_zscore": ("+m AS (SELECT median({c}) AS a FROM d), q AS (SELECT max(a) AS a, median(abs({c} - a)) / 0.6745 AS b FROM d, m)", "a - 1.2 * b", "a + 1.2 * b", 1.2),
    "percentile": ("+q AS (SELECT quantile_cont({c}, 0.01) AS a, quantile_cont({c}, 0.99) AS b FROM d)", "a", "b", 1.5),
}


def _outlier(method: str, strategy: str) -> Callable[[DataFrame], DataFrame]:
    def run(df: DataFrame) -> DataFrame:
        h = s.OutlierHandler()
        h.detect(df, ["price", "qty"] if strategy == "remove" else ["price"], method, BOUNDS[method][3])
        return rounded(h.transform(df, strategy), "price", to=2)

    return run


for _m, (_cte, _lo, _hi, _t) in BOUNDS.items():
    _out = f"(price < {_lo} OR price > {_hi})"
    _cells = {
        "cap": f"SELECT l_orderkey, l_linenumber, round(CASE WHEN price < {_lo} THEN {_lo} WHEN price > {_hi} THEN {_hi} ELSE price END, 2) AS price, qty FROM d, q",
        "flag": f"SELECT l_orderkey, l_linenumber, round(price, 2) AS price, qty, CASE WHEN {_out} THEN 1 ELSE 0 END AS price_is_outlier FROM d, q",
    }
    for _k, _f in (("impute_mean", "avg"), ("impute_median", "median")):
        _cells[_k] = f", f AS (SELECT {_f}(price) FILTER (WHERE NOT {_out}) AS fill FROM d, q) SELECT l_orderkey, l_linenumber, round(CASE WHEN {_out} THEN fill ELSE price END, 2) AS price, qty FROM d, q, f"
    for _k, _sql in _cells.items():
        add(f"outlier_{_m}_{_k}", OUT, _outlier(_m, _k), _cte.format(c="price") + _sql.replace("SELECT", " SELECT", 1))
    _q2 = _cte.format(c="qty").removeprefix("+").replace("q AS", "q2 AS").replace("m AS", "m2 AS").replace("d, m)", "d, m2)").replace(" AS a", " AS a2").replace(" AS b", " AS b2").replace("max(a)", "max(a2)").replace("- a)", "- a2)")
    _qty = f"(qty < {_lo} OR qty > {_hi})".replace("a -", "a2 -").replace("a +", "a2 +").replace("* b", "* b2").replace("b +", "b2 +").replace("b - a", "b2 - a2").replace("b2 - a2)", "b2 - a2)")
    if _m == "percentile":
        _qty = "(qty < a2 OR qty > b2)"
    elif _m == "iqr":
        _qty = "(qty < a2 - 0.5 * (b2 - a2) OR qty > b2 + 0.5 * (b2 - a2))"
    add(f"outlier_{_m}_remove", OUT, _outlier(_m, "remove"), f"{_cte.format(c='price')}, {_q2} SELECT l_orderkey, l_linenumber, round(price, 2) AS price, qty FROM d, q, q2 WHERE NOT coalesce({_out}, false) AND NOT coalesce({_qty}, false)")


def _outlier_report(df: DataFrame) -> DataFrame:
    h = s.OutlierHandler()
    h.detect(df, ["price", "qty"], "iqr", 0.5)
    h.transform(df, "cap")
    r = h.get_report()
    return rows(df.sparkSession, [(x.column, x.method, float(x.lower_bound), float(x.upper_bound), int(x.outlier_count), float(x.outlier_pct), x.treatment) for x in r.itertuples()], "column string, method string, lower_bound double, upper_bound double, outlier_count long, outlier_pct double, treatment string")


add("outlier_report", OUT, _outlier_report, "+u AS (SELECT 'price' AS c, price AS v FROM d UNION ALL SELECT 'qty', qty FROM d), q AS (SELECT c, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM u GROUP BY c) SELECT c AS \"column\", 'iqr' AS method, round(any_value(a - 0.5 * (b - a)), 4) AS lower_bound, round(any_value(b + 0.5 * (b - a)), 4) AS upper_bound, count(*) FILTER (WHERE v < a - 0.5 * (b - a) OR v > b + 0.5 * (b - a)) AS outlier_count, round(100.0::DOUBLE * count(*) FILTER (WHERE v < a - 0.5 * (b - a) OR v > b + 0.5 * (b - a)) / count(*), 2) AS outlier_pct, 'cap' AS treatment FROM u JOIN q USING (c) GROUP BY c")

# missing values ------------------------------------------------------------------------------------

MISS = View("lineitem", "l_orderkey", "l_linenumber", "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS qty", "CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_returnflag END AS flag", "CASE WHEN l_orderkey % 4 = 0 THEN l_tax END AS rare")


def _impute(**strategies: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: rounded(s.MissingValueHandler(strategies={"rare": "zero", "flag": "unknown", "qty": "zero"} | strategies).fit_transform(df), "qty")


_ids, _base = "l_orderkey, l_linenumber", "coalesce(flag, 'UNKNOWN') AS flag, coalesce(rare, 0) AS rare"
add("impute_mean", MISS, _impute(qty="mean"), f"SELECT {_ids}, round(coalesce(qty, (SELECT avg(qty) FROM d)), 4) AS qty, {_base} FROM d")
add("impute_median", MISS, _impute(qty="median"), f"SELECT {_ids}, coalesce(qty, (SELECT median(qty) FROM d)) AS qty, {_base} FROM d")
add("impute_mode", MISS, _impute(flag="mode", qty="mode"), f"SELECT {_ids}, coalesce(qty, (SELECT qty FROM d WHERE qty IS NOT NULL GROUP BY qty ORDER BY count(*) DESC, qty LIMIT 1)) AS qty, coalesce(flag, (SELECT flag FROM d WHERE flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1)) AS flag, coalesce(rare, 0) AS rare FROM d")
add("impute_zero_unknown", MISS, _impute(), f"SELECT {_ids}, coalesce(qty, 0) AS qty, {_base} FROM d")
add("impute_drop_rows", MISS, _impute(qty="drop_rows"), f"SELECT {_ids}, qty, {_base} FROM d WHERE qty IS NOT NULL")
add("impute_drop_column", MISS, lambda df: s.MissingValueHandler(strategies={"qty": "zero", "flag": "unknown"}).fit_transform(df), f"SELECT {_ids}, coalesce(qty, 0) AS qty, coalesce(flag, 'UNKNOWN') AS flag FROM d")
add("impute_flag_missing", MISS, _impute(qty="flag_missing"), f"SELECT {_ids}, qty, {_base}, CAST(qty IS NULL AS INT) AS qty_is_missing FROM d")
CARRY = View("orders", "o_orderkey", "o_custkey % 20 AS g", "CASE WHEN o_orderkey % 7 < 3 OR o_orderkey < 40 THEN NULL ELSE o_totalprice END AS qty")
_over = "OVER (ORDER BY o_orderkey ROWS BETWEEN"
for _how, _e in (
    ("ffill", f"last_value(qty IGNORE NULLS) {_over} UNBOUNDED PRECEDING AND CURRENT ROW)"),
    ("bfill", f"first_value(qty IGNORE NULLS) {_over} CURRENT ROW AND UNBOUNDED FOLLOWING)"),
):
    add(f"impute_{_how}", CARRY, lambda df, how=_how: carry(df, "qty", how, ["o_orderkey"]).select("o_orderkey", "qty"), f"SELECT o_orderkey, {_e} AS qty FROM d")
_line = f"""+n AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS i FROM d), w AS (SELECT *,
    last_value(CASE WHEN qty IS NOT NULL THEN i END IGNORE NULLS) {_over} UNBOUNDED PRECEDING AND CURRENT ROW) AS i0, last_value(qty IGNORE NULLS) {_over} UNBOUNDED PRECEDING AND CURRENT ROW) AS x0,
    first_value(CASE WHEN qty IS NOT NULL THEN i END IGNORE NULLS) {_over} CURRENT ROW AND UNBOUNDED FOLLOWING) AS i1, first_value(qty IGNORE NULLS) {_over} CURRENT ROW AND UNBOUNDED FOLLOWING) AS x1 FROM n)
    SELECT o_orderkey, round(CASE WHEN qty IS NOT NULL THEN qty WHEN x0 IS NULL THEN NULL WHEN x1 IS NULL THEN x0 ELSE x0 + (x1 - x0) * (i - i0) / (i1 - i0) END, 4) AS qty FROM w"""
add("impute_interpolate", CARRY, lambda df: rounded(carry(df, "qty", "interpolate", ["o_orderkey"]).select("o_orderkey", "qty"), "qty"), _line)
_part = "OVER (PARTITION BY g ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
add("impute_ffill_partitioned", CARRY, lambda df: carry(df, "qty", "ffill", ["o_orderkey"], ["g"]).select("o_orderkey", "qty"), f"SELECT o_orderkey, last_value(qty IGNORE NULLS) {_part} AS qty FROM d")


def _model_reuse(df: DataFrame) -> DataFrame:
    """Learn on one half, apply to the other."""
    h = s.MissingValueHandler(strategies={"rare": "zero"}).fit(df.where("l_orderkey % 2 = 0"))
    return h.transform(df.where("l_orderkey % 2 = 1"))


add("impute_fit_transform_split", MISS, _model_reuse, f"+t AS (SELECT * FROM d WHERE l_orderkey % 2 = 0) SELECT {_ids}, coalesce(qty, (SELECT median(qty) FROM t)) AS qty, coalesce(flag, (SELECT flag FROM t WHERE flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1)) AS flag, coalesce(rare, 0) AS rare FROM d WHERE l_orderkey % 2 = 1")


def _missing_report(df: DataFrame) -> DataFrame:
    h = s.MissingValueHandler(strategies={"qty": "median"})
    h.fit_transform(df)
    r = h.get_report()
    return rows(df.sparkSession, [(x.column, int(x.missing_count), float(x.missing_pct), x.strategy, str(x.fill_value)) for x in r.itertuples()], "column string, missing_count long, missing_pct double, strategy string, fill_value string")


add("impute_report", MISS, _missing_report, """SELECT 'qty' AS "column", count(*) FILTER (WHERE qty IS NULL) AS missing_count, round(100.0::DOUBLE * count(*) FILTER (WHERE qty IS NULL) / count(*), 2) AS missing_pct, 'median' AS strategy, CAST(CAST(median(qty) AS DOUBLE) AS VARCHAR) AS fill_value FROM d
    UNION ALL SELECT 'flag', count(*) FILTER (WHERE flag IS NULL), round(100.0::DOUBLE * count(*) FILTER (WHERE flag IS NULL) / count(*), 2), 'mode', (SELECT flag FROM d WHERE flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1) FROM d
    UNION ALL SELECT 'rare', count(*) FILTER (WHERE rare IS NULL), round(100.0::DOUBLE * count(*) FILTER (WHERE rare IS NULL) / count(*), 2), 'drop_column', 'DROPPED' FROM d""")


def _analysis(df: DataFrame) -> DataFrame:
    r = s.MissingValueHandler().analyze(df)
    return rows(df.sparkSession, [(x.column, x.dtype, int(x.missing_count), float(x.missing_pct), int(x.unique_values), x.recommended_strategy) for x in r.itertuples()], "column string, dtype string, missing_count long, missing_pct double, unique_values long, recommended_strategy string")


def _analysis_sql(c: str, t: str, numeric: bool) -> str:
    known = f"CASE WHEN count({c}) > 2 AND abs(skewness({c})) > 1 THEN 'median' ELSE 'mean' END" if numeric else "'mode'"
    share = f"1.0::DOUBLE * count(*) FILTER (WHERE {c} IS NULL) / count(*)"
    return f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count(*) FILTER (WHERE {c} IS NULL) AS missing_count, round(100 * {share}, 2) AS missing_pct, count(DISTINCT {c}) AS unique_values, CASE WHEN {share} > 0.7 THEN 'drop_column' WHEN {share} > 0.5 THEN 'flag_missing' ELSE {known} END AS recommended_strategy FROM d"


add("missing_analyze", MISS, _analysis, " UNION ALL ".join(_analysis_sql(*x) for x in (("l_orderkey", "bigint", True), ("l_linenumber", "int", True), ("qty", "double", True), ("flag", "string", False), ("rare", "double", True))))
add("drop_na_rows", MISS, lambda df: s.drop_na(df, subset=["qty", "flag"]), "SELECT * FROM d WHERE qty IS NOT NULL AND flag IS NOT NULL")
add("drop_na_rows_all", MISS, lambda df: s.drop_na(df, how="all", subset=["qty", "flag"]), "SELECT * FROM d WHERE qty IS NOT NULL OR flag IS NOT NULL")
add("drop_na_columns", MISS, lambda df: s.drop_na(df, axis=1), f"SELECT {_ids} FROM d")
add("fill_na", MISS, lambda df: s.fill_na(df, -1, "none"), f"SELECT {_ids}, coalesce(qty, -1) AS qty, coalesce(flag, 'none') AS flag, coalesce(rare, -1) AS rare FROM d")
add("missing_indicators", MISS, lambda df: s.add_missing_indicators(df, ["qty", "flag", "absent"]), "SELECT *, CAST(qty IS NULL AS INT) AS qty_is_missing, CAST(flag IS NULL AS INT) AS flag_is_missing FROM d")
add("missing_indicator_fitted", MISS, lambda df: s.MissingIndicator().fit_transform(df), "SELECT *, CAST(qty IS NULL AS INT) AS qty_is_missing, CAST(flag IS NULL AS INT) AS flag_is_missing, CAST(rare IS NULL AS INT) AS rare_is_missing FROM d")

# duplicates ----------------------------------------------------------------------------------------

DUP = View("orders", "o_orderkey", "o_custkey % 50 AS k", "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderpriority END AS p", "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS v", "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS st")
_full = "(CASE WHEN p IS NULL THEN 0 ELSE 1 END + CASE WHEN v IS NULL THEN 0 ELSE 1 END + CASE WHEN st IS NULL THEN 0 ELSE 1 END)"


def _dedup(survivorship: str) -> Callable[[DataFrame], DataFrame]:
    def run(df: DataFrame) -> DataFrame:
        h = s.DuplicateHandler(order_by=["o_orderkey"])
        h.find_exact(df, ["k", "p"])
        return h.transform(df, survivorship)

    return run


for _k, _o in (("first", "o_orderkey"), ("last", "o_orderkey DESC"), ("most_complete", f"{_full} DESC, o_orderkey")):
    add(f"dedup_exact_{_k}", DUP, _dedup(_k), f"SELECT o_orderkey, k, p, v, st FROM d QUALIFY row_number() OVER (PARTITION BY k, p ORDER BY {_o}) = 1")
_fw = "OVER (PARTITION BY k, p ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
add("dedup_exact_merge", DUP, _dedup("merge"), f"SELECT o_orderkey, k, p, coalesce(v, first_value(v IGNORE NULLS) {_fw}) AS v, coalesce(st, first_value(st IGNORE NULLS) {_fw}) AS st FROM d QUALIFY row_number() OVER (PARTITION BY k, p ORDER BY {_full} DESC, o_orderkey) = 1")
add("dedup_groups", DUP, lambda df: s.DuplicateHandler().find_exact(df, ["k", "p"]).select("k", "p", "size", F.col("group_id").cast("long").alias("group_id")), "SELECT k, p, count(*) AS size, row_number() OVER (ORDER BY k NULLS LAST, p NULLS LAST) - 1 AS group_id FROM d GROUP BY k, p HAVING count(*) > 1")


def _dup_report(df: DataFrame) -> DataFrame:
    h = s.DuplicateHandler(order_by=["o_orderkey"])
    h.find_exact(df, ["k", "p"])
    h.transform(df)
    r = h.get_report().iloc[0]
    return rows(df.sparkSession, [(int(r.duplicates_found), int(r.groups), int(r.rows_before), int(r.rows_after), int(r.rows_removed), r.method, r.survivorship)], "duplicates_found long, groups long, rows_before long, rows_after long, rows_removed long, method string, survivorship string")


add("dedup_report", DUP, _dup_report, "+g AS (SELECT count(*) AS n FROM d GROUP BY k, p) SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates_found, count(*) FILTER (WHERE n > 1) AS groups, CAST(sum(n) AS BIGINT) AS rows_before, count(*) AS rows_after, CAST(sum(n - 1) AS BIGINT) AS rows_removed, 'exact' AS method, 'most_complete' AS survivorship FROM g")
add("dedup_documents_text", View("documents", "doc_id", "text", "lang"), lambda df: _on(s.DuplicateHandler(order_by=["doc_id"]), df, ["text"]).select("doc_id", "lang"), "SELECT doc_id, lang FROM d QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")


def _on(h: s.DuplicateHandler, df: DataFrame, subset: list[str]) -> DataFrame:
    h.find_exact(df, subset)
    return h.transform(df, "first")


def _fuzzy(df: DataFrame) -> DataFrame:
    h = s.DuplicateHandler(order_by=["s_suppkey"])
    groups = h.find_fuzzy(df, ["s_name"], 0.9, "s_nationkey")
    ids = h._ids.select("__row_id", "s_suppkey")
    seeds = ids.select(F.col("__row_id").alias("g"), F.col("s_suppkey").alias("seed"))
    return groups.join(ids, groups["row_id"] == ids["__row_id"]).join(seeds, groups["group_id"] == seeds["g"]).select("seed", "s_suppkey", F.round("score", 4).alias("score"), "match_type")


def _fuzzy_keep(df: DataFrame) -> DataFrame:
    h = s.DuplicateHandler(order_by=["s_suppkey"])
    h.find_fuzzy(df, ["s_name"], 0.9, "s_nationkey")
    return h.transform(df, "first").select("s_suppkey", "s_name")


SUPP = View("supplier", "s_suppkey", "s_name", "s_nationkey")
add("dedup_fuzzy_groups", SUPP, _fuzzy, None)
add("dedup_fuzzy_first", SUPP, _fuzzy_keep, None)


def _fuzzy_one_block(df: DataFrame) -> DataFrame:
    """All customers in one block: the name is compared across the whole table."""
    h = s.DuplicateHandler(order_by=["c_custkey"])
    groups = h.find_fuzzy(df, ["c_name", "c_mktsegment"], 0.95)
    ids = h._ids.select("__row_id", "c_custkey")
    seeds = ids.select(F.col("__row_id").alias("g"), F.col("c_custkey").alias("seed"))
    return groups.join(ids, groups["row_id"] == ids["__row_id"]).join(seeds, groups["group_id"] == seeds["g"]).select("seed", "c_custkey", F.round("score", 4).alias("score"))


add("dedup_fuzzy_one_block", View("customer", "c_custkey", "c_name", "c_mktsegment"), _fuzzy_one_block, None)
STEM = "abcdefghijklmnopqrstuvwxyz"
STEMS = View("customer", "c_custkey", "c_nationkey", f"substring('{STEM}', 1, 5 + CAST(c_custkey * 7 % 20 AS INT)) AS t", f"CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE substring('{STEM}', 1, 3 + CAST(c_custkey % 6 AS INT)) END AS u")


def _fuzzy_stems(df: DataFrame) -> DataFrame:
    """Two columns are compared within nations; of two beginnings of one word the ratio follows from their lengths."""
    h = s.DuplicateHandler(order_by=["c_custkey"])
    groups = h.find_fuzzy(df, ["t", "u"], 0.8, "c_nationkey")
    ids = h._ids.select("__row_id", "c_custkey")
    seeds = ids.select(F.col("__row_id").alias("g"), F.col("c_custkey").alias("seed"))
    return groups.join(ids, groups["row_id"] == ids["__row_id"]).join(seeds, groups["group_id"] == seeds["g"]).select("seed", "c_custkey", F.round("score", 4).alias("score"))


_ratio = "coalesce(2.0::DOUBLE * least(len(x.{c}), len(o.{c})) / (len(x.{c}) + len(o.{c})), 0)"
add("dedup_fuzzy_stems", STEMS, _fuzzy_stems, None)
ORACLES["dedup_fuzzy_stems"] = f"""WITH RECURSIVE d AS ({STEMS.sql}), o AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i FROM d),
    w AS (
        SELECT c_nationkey, i, c_custkey, c_custkey AS seed, 1.0::DOUBLE AS score, [{{'k': c_custkey, 't': t, 'u': u}}] AS seeds FROM o WHERE i = 1
        UNION ALL
        SELECT c_nationkey, i, c_custkey, coalesce(f.k, c_custkey), coalesce(f.score, 1.0), CASE WHEN f IS NULL THEN list_append(seeds, {{'k': c_custkey, 't': t, 'u': u}}) ELSE seeds END
        FROM (
            SELECT o.*, w.seeds, list_filter(list_transform(w.seeds, lambda x: {{'k': x.k, 'score': ({_ratio.format(c='t')} + {_ratio.format(c='u')}) / 2}}), lambda y: y.score >= 0.8)[1] AS f
            FROM w JOIN o ON o.c_nationkey = w.c_nationkey AND o.i = w.i + 1)),
    g AS (SELECT *, count(*) OVER (PARTITION BY seed) AS n FROM w)
    SELECT seed, c_custkey, round(score, 4) AS score FROM g WHERE n > 1"""
add("dedup_members", DUP, lambda df: s.DuplicateHandler().exact_members(df, ["k", "p"]).select(F.col("group_id").cast("long").alias("group_id"), "o_orderkey", "score", "match_type"), "+g AS (SELECT k, p, row_number() OVER (ORDER BY k NULLS LAST, p NULLS LAST) - 1 AS group_id FROM d GROUP BY k, p HAVING count(*) > 1) SELECT group_id, o_orderkey, 1.0::DOUBLE AS score, 'exact' AS match_type FROM d JOIN g ON d.k IS NOT DISTINCT FROM g.k AND d.p IS NOT DISTINCT FROM g.p")

# text ----------------------------------------------------------------------------------------------

CUST = View("customer", "c_custkey", "CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE concat('  ', upper(c_name), '   o''connor ', c_mktsegment, ' ') END AS t")
WHOLE = View("documents", "doc_id AS k", "text AS t")
_ws = r"regexp_replace({x}, '\s+', ' ', 'g')"


def _text(f: Callable[[Any], Any]) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumn("t", f(F.col("t")))


def _strip_sql(x: str) -> str:
    return f"trim({_ws.format(x=x)})"


def _title_sql(x: str) -> str:
    return rf"array_to_string(list_transform(regexp_extract_all({x}, '\p{{L}}+|\P{{L}}+'), lambda q: upper(q[1]) || lower(q[2:])), '')"


add("text_strip", CUST, _text(fx.strip_whitespace), f"SELECT c_custkey, {_strip_sql('t')} AS t FROM d")
add("text_lower", CUST, _text(F.lower), "SELECT c_custkey, lower(t) AS t FROM d")
add("text_upper", CUST, _text(F.upper), "SELECT c_custkey, upper(t) AS t FROM d")
add("text_title", CUST, _text(fx.titlecase), f"SELECT c_custkey, {_title_sql('t')} AS t FROM d")
add("text_special", WHOLE, _text(lambda c: fx.remove_special_chars(c, "-.")), r"SELECT k, regexp_replace(t, '[^a-zA-Z0-9\s\-.]', '', 'g') AS t FROM d")
add("text_emails", WHOLE, _text(fx.remove_emails), r"SELECT k, regexp_replace(regexp_replace(t, '\S+@\S+\.\S+', '', 'g'), '^\s+|\s+$', '', 'g') AS t FROM d")
URLS = View("pages", "page_id", "concat('see ', url, ' or www.example.org/x now ') AS t")
add("text_urls", URLS, _text(fx.remove_urls), r"SELECT page_id, regexp_replace(regexp_replace(t, 'https?://\S+|www\.\S+', '', 'g'), '^\s+|\s+$', '', 'g') AS t FROM d")
HTML = View("pages", "page_id", "html AS t")


def _html_sql(x: str) -> str:
    for a, b in fx.ENTITIES:
        x = "replace({}, '{}', '{}')".format(x, a, b.replace("'", "''"))
    return rf"regexp_replace(regexp_replace({x}, '<[^>]+>', '', 'g'), '^\s+|\s+$', '', 'g')"


add("text_html", HTML, _text(fx.remove_html), f"SELECT page_id, {_html_sql('t')} AS t FROM d")
add("text_accents", WHOLE, _text(fx.remove_accents), "SELECT k, strip_accents(t) AS t FROM d")
add("text_accents_exact", WHOLE, _text(fx.remove_accents_exact), "SELECT k, strip_accents(t) AS t FROM d")
#: Fixed: composed letters of Latin-1, by the code point of the mark that follows the letter when they are taken apart.
COMPOSED = {768: "ÀÈÌÒÙàèìòù", 769: "ÁÉÍÓÚÝáéíóúý", 770: "ÂÊÎÔÛâêîôû", 771: "ÃÑÕãñõ", 776: "ÄËÏÖÜäëïöüÿ", 778: "Åå", 807: "Çç"}
_apart = "t"
for _mark, _letters in COMPOSED.items():
    for _c in _letters:
        _apart = f"replace({_apart}, '{_c}', strip_accents('{_c}') || chr({_mark}))"
add("text_normalize_unicode", WHOLE, _text(fx.normalize_unicode), f"SELECT k, {_apart} AS t FROM d")
add("text_name", CUST, lambda df: s.TextCleaner().clean_names(df, "t"), f"SELECT c_custkey, strip_accents({_title_sql(_strip_sql('t'))}) AS t FROM d")
ADDR = View("customer", "c_custkey", "concat(CAST(c_custkey AS STRING), ' Main  ', CASE WHEN c_custkey % 4 = 0 THEN 'St.' WHEN c_custkey % 4 = 1 THEN 'AVE' WHEN c_custkey % 4 = 2 THEN 'Blvd' ELSE 'Rd, Apt' END, ' ', c_mktsegment) AS t")
_addr = f"lower({_strip_sql('t')})"
for _a, _b in fx.ABBREVIATIONS:
    _addr = rf"regexp_replace({_addr}, '\b{_a}\.?\b', '{_b}', 'g')"
add("text_address", ADDR, lambda df: s.TextCleaner().clean_addresses(df, "t"), f"SELECT c_custkey, {_addr} AS t FROM d")
_desc = _html_sql(_strip_sql("t"))
add("text_description", HTML, lambda df: s.TextCleaner().clean_descriptions(df, "t").withColumn("t", fx.strip_whitespace(F.col("t"))), rf"SELECT page_id, {_strip_sql(rf"lower(regexp_replace(regexp_replace({_desc}, 'https?://\S+|www\.\S+', '', 'g'), '^\s+|\s+$', '', 'g'))")} AS t FROM d")
add("text_code", View("part", "p_partkey", "concat(' ', lower(p_brand), ' - ', p_type, ' ') AS t"), lambda df: s.TextCleaner().clean_codes(df, "t"), rf"SELECT p_partkey, regexp_replace(upper({_strip_sql('t')}), '\s+', '', 'g') AS t FROM d")
MAIL = View("customer", "c_custkey", "CASE WHEN c_custkey % 5 = 0 THEN 'none' ELSE concat(' ', upper(c_name), '@Example.COM ') END AS t")
add("text_email", MAIL, lambda df: s.TextCleaner().clean_emails(df, "t"), r"SELECT c_custkey, CASE WHEN contains(t, '@') THEN regexp_replace(lower(t), '^\s+|\s+$', '', 'g') END AS t FROM d")
PHONE = View("customer", "c_custkey", "CASE WHEN c_custkey % 6 = 0 THEN '555-12' ELSE concat('+1 (', CAST(200 + c_custkey % 700 AS STRING), ') 555.', CAST(1000 + c_custkey % 9000 AS STRING)) END AS t")
add("text_phone", PHONE, lambda df: s.TextCleaner().clean_phones(df, "t"), r"SELECT c_custkey, CASE WHEN length(regexp_replace(t, '[^0-9]', '', 'g')) >= 10 THEN regexp_replace(right(regexp_replace(t, '[^0-9]', '', 'g'), 10), '^(\d{3})(\d{3})(\d{4})$', '(\1) \2-\3') END AS t FROM d")
ALL = View("customer", "c_custkey", "concat('  ', lower(c_name), ' ') AS n", "concat(c_mktsegment, ' x ') AS c", "c_mktsegment AS other")
add("text_clean_all", ALL, lambda df: s.TextCleaner().clean_all(df, {"n": "name", "c": "code", "absent": "name", "other": "unknown"}), rf"SELECT c_custkey, strip_accents({_title_sql(_strip_sql('n'))}) AS n, regexp_replace(upper({_strip_sql('c')}), '\s+', '', 'g') AS c, other FROM d")
add("text_transform", ALL, lambda df: s.TextCleaner().transform(df), f"SELECT c_custkey, {_strip_sql('n')} AS n, {_strip_sql('c')} AS c, {_strip_sql('other')} AS other FROM d")


def _text_report(df: DataFrame) -> DataFrame:
    t = s.TextCleaner()
    t.transform(df)
    return rows(df.sparkSession, [(x.column, x.transformations, int(x.rows_modified)) for x in t.get_report().itertuples()], "column string, transformations string, rows_modified long")


add("text_report", ALL, _text_report, "SELECT 'n' AS \"column\", 'strip_whitespace' AS transformations, count(*) FILTER (WHERE n <> " + _strip_sql("n") + ") AS rows_modified FROM d UNION ALL SELECT 'c', 'strip_whitespace', count(*) FILTER (WHERE c <> " + _strip_sql("c") + ") FROM d")

# categories ----------------------------------------------------------------------------------------

CAT = View("customer", "c_custkey", "CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE c_mktsegment END AS seg", "concat('n', CAST(c_nationkey AS STRING)) AS nat")
add("cat_case", CAT, lambda df: s.CategoryStandardizer(normalize_case=True).transform(df), "SELECT c_custkey, lower(seg) AS seg, lower(nat) AS nat FROM d")
add("cat_map", CAT, lambda df: s.CategoryStandardizer(mappings={"seg": {"BUILDING": "MACHINERY", "MACHINERY": "TOOLS"}}).transform(df), "SELECT c_custkey, CASE seg WHEN 'BUILDING' THEN 'MACHINERY' WHEN 'MACHINERY' THEN 'TOOLS' ELSE seg END AS seg, nat FROM d")
add("cat_group", CAT, lambda df: s.CategoryStandardizer().add_grouping("seg", {"BUILDING": "B", "AUTOMOBILE": "B"}).transform(df), "SELECT c_custkey, CASE WHEN seg IN ('BUILDING', 'AUTOMOBILE') THEN 'B' ELSE seg END AS seg, nat FROM d")
add("cat_rare", CAT, lambda df: s.CategoryStandardizer(rare_threshold=60).transform(df), "SELECT c_custkey, CASE WHEN seg IS NULL THEN NULL WHEN count(*) OVER (PARTITION BY seg) < 60 THEN 'Other' ELSE seg END AS seg, CASE WHEN count(*) OVER (PARTITION BY nat) < 60 THEN 'Other' ELSE nat END AS nat FROM d")


def _cat_report(df: DataFrame) -> DataFrame:
    c = s.CategoryStandardizer(mappings={"seg": {"building": "machinery"}}, normalize_case=True)
    c.transform(df)
    return rows(df.sparkSession, [(x.column, x.action, int(x.unique_before), int(x.unique_after), int(x.rows_modified)) for x in c.get_report().itertuples()], "column string, action string, unique_before long, unique_after long, rows_modified long")


add("cat_report", CAT, _cat_report, "SELECT 'seg' AS \"column\", 'normalize_case' AS action, count(DISTINCT seg) AS unique_before, count(DISTINCT lower(seg)) AS unique_after, count(*) FILTER (WHERE seg <> lower(seg)) AS rows_modified FROM d UNION ALL SELECT 'seg', 'value_mapping', count(DISTINCT lower(seg)), count(DISTINCT replace(lower(seg), 'building', 'machinery')), count(*) FILTER (WHERE lower(seg) = 'building') FROM d")

# type standardisation ------------------------------------------------------------------------------

STD = View(
    "orders", "o_orderkey", "CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN ' Yes' ELSE 'NO' END AS b", "concat(CAST(o_orderkey % 100 AS STRING), CASE WHEN o_orderkey % 19 = 0 THEN '' ELSE ' %' END) AS pct",
    "concat('$', CAST(o_orderkey % 9 AS STRING), ',', lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0'), CASE WHEN o_orderkey % 23 = 0 THEN '.25' WHEN o_orderkey % 29 = 0 THEN 'x' ELSE '.50' END) AS money",
    "CAST(o_custkey AS STRING) AS whole", "CASE WHEN o_orderkey % 3 = 0 THEN substring(CAST(o_orderdate AS STRING), 1, 10) WHEN o_orderkey % 31 = 0 THEN 'soon' ELSE concat(substring(CAST(o_orderdate AS STRING), 6, 2), '/', substring(CAST(o_orderdate AS STRING), 9, 2), '/', substring(CAST(o_orderdate AS STRING), 1, 4)) END AS day", "o_orderpriority AS free",
)
_money = "replace(replace(money, '$', ''), ',', '')"
_std = {
    "b": "CASE WHEN lower(trim(b)) = 'yes' THEN true WHEN lower(trim(b)) = 'no' THEN false END", "pct": "round(CAST(trim(replace(pct, '%', '')) AS DOUBLE) / 100.0, 6)", "money": f"try_cast({_money} AS DOUBLE)",
    "whole": "CAST(whole AS BIGINT)", "day": "CAST(coalesce(try_strptime(day, '%Y-%m-%d'), try_strptime(day, '%m/%d/%Y')) AS VARCHAR)", "free": "free",
}


def _standard(df: DataFrame) -> DataFrame:
    out = s.DataStandardizer().transform(df)
    return out.withColumns({"day": F.date_format("day", "yyyy-MM-dd HH:mm:ss"), "pct": F.round("pct", 6)})


add("std_auto", STD, _standard, "SELECT o_orderkey, " + ", ".join(f"{v} AS {k}" for k, v in _std.items()) + " FROM d")


def _std_report(df: DataFrame) -> DataFrame:
    d = s.DataStandardizer()
    d.transform(df)
    return rows(df.sparkSession, [(x.column, x.original_dtype, x.new_dtype, int(x.success_count), int(x.failed_count)) for x in d.get_report().itertuples()], "column string, original_dtype string, new_dtype string, success_count long, failed_count long")


_new = {"b": "boolean", "pct": "double", "money": "double", "whole": "bigint", "day": "timestamp_ntz"}
add("std_report", STD, _std_report, " UNION ALL ".join(f"SELECT '{c}' AS \"column\", 'string' AS original_dtype, '{t}' AS new_dtype, count({_std[c]}) AS success_count, count({c}) - count({_std[c]}) AS failed_count FROM d" for c, t in _new.items()))

# features ------------------------------------------------------------------------------------------

NUM = View("customer", "c_custkey", "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS x")
_scale = {"standard": ("avg(x)", "stddev_pop(x)"), "minmax": ("min(x)", "max(x) - min(x)"), "robust": ("median(x)", "quantile_cont(x, 0.75) - quantile_cont(x, 0.25)")}
for _k, (_c, _r) in _scale.items():
    add(f"scale_{_k}", NUM, lambda df, k=_k: rounded(s.FeatureScaler(columns=["x"], auto_transform=False, scaling_method=k).fit_transform(df), "x"), f"+q AS (SELECT {_c} AS c, {_r} AS r FROM d) SELECT c_custkey, round((x - c) / r, 4) AS x FROM d, q")
SKEW = View("lineitem", "l_orderkey", "l_linenumber", "exp(l_quantity / 10.0) AS x", "l_discount AS y")


def _chosen(df: DataFrame) -> DataFrame:
    t = s.NumericalTransformer(columns=["x", "y"], auto_transform=True, scaling_method=None).fit(df)
    return rows(df.sparkSession, [(c, m.transform, round(m.shift, 4), round(m.lam, 2)) for c, m in t.model.items()], "column string, transform string, shift double, lambda double")


_box = "CASE WHEN abs(lam) < 1e-9 THEN ln(v) ELSE (pow(v, lam) - 1) / lam END"
_yeo = "CASE WHEN v < 0 THEN CASE WHEN abs(lam - 2) < 1e-9 THEN -ln(1 - v) ELSE -(pow(1 - v, 2 - lam) - 1) / (2 - lam) END WHEN abs(lam) < 1e-9 THEN ln(1 + v) ELSE (pow(v + 1, lam) - 1) / lam END"
_power = f"CASE f WHEN 'none' THEN v WHEN 'log' THEN ln(v) WHEN 'boxcox' THEN {_box} ELSE {_yeo} END"
_auto = """+u AS (
    SELECT c, f, CASE WHEN f IN ('log', 'boxcox') THEN v + shift ELSE v END AS v, CASE WHEN f IN ('log', 'boxcox') THEN shift ELSE 0 END AS shift
    FROM (SELECT c, v, CASE WHEN min(v) OVER (PARTITION BY c) <= 0 THEN abs(min(v) OVER (PARTITION BY c)) + 1.0 ELSE 0.0 END::DOUBLE AS shift FROM (SELECT 'x' AS c, x AS v FROM d UNION ALL SELECT 'y', y FROM d)),
        (VALUES ('none'), ('log'), ('boxcox'), ('yeojohnson')) AS forms(f)),
    l AS (SELECT c, f, CASE f WHEN 'boxcox' THEN sum(ln(v)) ELSE sum(sign(v) * ln(1 + abs(v))) END AS logs, count(v) AS n FROM u WHERE f IN ('boxcox', 'yeojohnson') GROUP BY c, f),
    b0 AS (SELECT c, f, -2.0::DOUBLE AS lo, CASE f WHEN 'boxcox' THEN 2.0 ELSE 4.0 END::DOUBLE AS hi, 1.0::DOUBLE AS lam FROM l)"""
for _i in range(s.NumericalTransformer.ROUNDS):  # the grid of exponents that the fit goes through, round by round
    _auto += f""",
    g{_i} AS (SELECT c, f, hi - lo AS wide, i, lo + (hi - lo) * i / 8 AS lam FROM b{_i}, range(9) AS t(i)),
    b{_i + 1} AS (
        SELECT c, f, lam - wide / 8 AS lo, lam + wide / 8 AS hi, lam FROM (SELECT c, f, wide, i, lam, var_pop({_power}) AS spread FROM g{_i} JOIN u USING (c, f) GROUP BY ALL) JOIN l USING (c, f)
        QUALIFY row_number() OVER (PARTITION BY c, f ORDER BY -n / 2.0::DOUBLE * ln(spread) + (lam - 1) * logs DESC, i) = 1)"""
_auto += f""",
    o AS (SELECT c, f, shift, coalesce(lam, 0) AS lam, skewness({_power}) AS skew, kurtosis({_power}) AS kurt FROM u LEFT JOIN (SELECT c, f, lam FROM b{s.NumericalTransformer.ROUNDS}) USING (c, f) GROUP BY c, f, shift, lam),
    best AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY c ORDER BY abs(skew) + abs(kurt) / 3, list_position(['none', 'log', 'boxcox', 'yeojohnson'], f)) = 1)"""
add("features_auto_choice", SKEW, _chosen, _auto + " SELECT c AS \"column\", f AS transform, round(shift, 4) AS shift, round(lam, 2) AS lambda FROM best")
_changed = f"(SELECT l_orderkey, l_linenumber, y, {_power} AS x FROM (SELECT d.* EXCLUDE (x), d.x + shift AS v, f, lam FROM d, best WHERE c = 'x'))"
add(
    "features_auto_transform", SKEW, lambda df: rounded(s.NumericalTransformer(columns=["x"], auto_transform=True, scaling_method="standard").fit_transform(df), "x"),
    _auto + f" SELECT l_orderkey, l_linenumber, round((x - avg(x) OVER ()) / stddev_pop(x) OVER (), 4) AS x, y FROM {_changed}",
)


def _normality(df: DataFrame) -> DataFrame:
    """Distance from normal of two columns as they are, of their logarithms and of one power transform."""
    fitted = {"none": Fitted(), "log": Fitted("log", 1.0), "yeojohnson": Fitted("yeojohnson", 0.0, 0.5)}
    t = s.NumericalTransformer()
    got = df.agg(*[F.round(t._normality(m.transformed(F.col(c))), 4).alias(f"{c}/{k}") for c in ("x", "y") for k, m in fitted.items()])
    return got.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in got.columns]), F.array(*[F.col(f"`{c}`") for c in got.columns])))).select(F.col("key").alias("transformed"), F.col("value").alias("score"))


_forms = {"none": "{c}", "log": "ln({c} + 1)", "yeojohnson": "(pow({c} + 1, 0.5) - 1) / 0.5"}
add("features_normality", SKEW, _normality, " UNION ALL ".join(f"SELECT '{c}/{k}' AS transformed, round(abs(skewness({v.format(c=c)})) + abs(kurtosis({v.format(c=c)})) / 3, 4) AS score FROM d" for c in ("x", "y") for k, v in _forms.items()))
add("features_log", SKEW, lambda df: df.select("l_orderkey", "l_linenumber", F.round(Fitted("log", 1.0).transformed(F.col("y")), 6).alias("y")), f"SELECT {_ids}, round(ln(y + 1), 6) AS y FROM d")
SIGNED = View("customer", "c_custkey", "c_acctbal / 1000 AS x")
add("features_yeojohnson", SIGNED, lambda df: df.select("c_custkey", F.round(yeojohnson(F.col("x"), 0.5), 6).alias("x")), "SELECT c_custkey, round(CASE WHEN x >= 0 THEN (pow(x + 1, 0.5) - 1) / 0.5 ELSE -(pow(1 - x, 1.5) - 1) / 1.5 END, 6) AS x FROM d")
add("features_boxcox", SKEW, lambda df: df.select("l_orderkey", "l_linenumber", F.round(boxcox(F.col("x"), 0.5), 4).alias("x")), f"SELECT {_ids}, round((pow(x, 0.5) - 1) / 0.5, 4) AS x FROM d")
DATES = View("orders", "o_orderkey", "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderdate END AS od")
_month, _dow = "month(od)", "(isodow(od) - 1)"
_date_sets = {
    "basic": (["year", "month", "day", "weekday", "quarter"], {"year": "CAST(year(od) AS INT)", "month": "CAST(month(od) AS INT)", "day": "CAST(day(od) AS INT)", "weekday": f"CAST({_dow} AS INT)", "quarter": "CAST(quarter(od) AS INT)"}),
    "flags": (["flags", "is_month_start", "is_month_end"], {"is_weekend": f"CAST(coalesce({_dow} >= 5, false) AS INT)", "is_month_start": "CAST(coalesce(day(od) = 1, false) AS INT)", "is_month_end": "CAST(coalesce(CAST(od AS DATE) = last_day(od), false) AS INT)"}),
    "cyclical": (["cyclical"], {"month_sin": f"round(sin(2 * pi() * {_month} / 12), 6)", "month_cos": f"round(cos(2 * pi() * {_month} / 12), 6)", "weekday_sin": f"round(sin(2 * pi() * {_dow} / 7), 6)", "weekday_cos": f"round(cos(2 * pi() * {_dow} / 7), 6)"}),
    "season": (["season"], {"season": f"CASE WHEN {_month} IN (12, 1, 2) THEN 'Winter' WHEN {_month} IN (3, 4, 5) THEN 'Spring' WHEN {_month} IN (6, 7, 8) THEN 'Summer' WHEN {_month} IN (9, 10, 11) THEN 'Fall' END"}),
}


def _dates(features: list[str]) -> Callable[[DataFrame], DataFrame]:
    def run(df: DataFrame) -> DataFrame:
        out = s.DateFeatureExtractor(features, drop_original=True).transform(df)
        waves = [c for c in out.columns if c.endswith(("_sin", "_cos"))]
        return out.withColumns({c: F.round(F.col(c), 6) + 0.0 for c in waves}) if waves else out

    return run


for _k, (_fs, _es) in _date_sets.items():
    add(f"date_{_k}", DATES, _dates(_fs), "SELECT o_orderkey, " + ", ".join(f"{e}{' + 0.0' if e.startswith('round') else ''} AS od_{n}" for n, e in _es.items()) + " FROM d")
SEL = View("lineitem", "l_orderkey", "l_quantity AS a", "l_quantity * 2 + 1 AS b", "1 AS one", "l_discount AS c", "CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_tax END AS e")


def _selected(**options: Any) -> Callable[[DataFrame], DataFrame]:
    return lambda df: s.FeatureSelector(**options).fit_transform(df.drop("l_orderkey")).withColumn("n", F.lit(1))


add("select_variance_correlation", SEL, _selected(), "SELECT a, c, e, 1 AS n FROM d")
add("select_variance_only", SEL, _selected(correlated=False), "SELECT a, b, c, e, 1 AS n FROM d")
add("select_correlation_matrix", SEL, lambda df: _correlations(df.drop("l_orderkey", "one")), "SELECT round(corr(a, b), 6) AS ab, round(corr(a, c), 6) AS ac, round(corr(a, e), 6) AS ae, round(corr(c, e), 6) AS ce FROM d")


def _correlations(df: DataFrame) -> DataFrame:
    pair = lambda x, y: F.round(F.try_divide(F.covar_samp(x, y), F.stddev_samp(F.when(y.isNotNull(), x)) * F.stddev_samp(F.when(x.isNotNull(), y))), 6)
    return df.agg(*[pair(F.col(a), F.col(b)).alias(a + b) for a, b in ("ab", "ac", "ae", "ce")])


# quality, profiles, schema -------------------------------------------------------------------------


def _quality(df: DataFrame) -> DataFrame:
    q = s.check_quality(df)
    return rows(df.sparkSession, [(q["total_rows"], q["total_columns"], q["total_missing_values"], q["duplicate_rows"], float(q["completeness_percentage"]))], "total_rows long, total_columns long, total_missing_values long, duplicate_rows long, completeness_percentage double")


QUAL = View("lineitem", "l_linenumber", "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS qty", "l_returnflag")
add("quality_report", QUAL, _quality, "SELECT count(*) AS total_rows, 3 AS total_columns, count(*) FILTER (WHERE qty IS NULL) AS total_missing_values, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS duplicate_rows, round((1 - count(*) FILTER (WHERE qty IS NULL) / (3.0::DOUBLE * count(*))) * 100, 2) AS completeness_percentage FROM d")


def _quality_columns(df: DataFrame) -> DataFrame:
    q = s.check_quality(df)
    return rows(df.sparkSession, [(c, n, float(q["column_completeness"][c]), q["dtypes"][c]) for c, n in q["missing_values"].items()], "column string, missing long, completeness double, dtype string")


add("quality_columns", QUAL, _quality_columns, " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, round(count({c}) * 100.0::DOUBLE / count(*), 2) AS completeness, '{t}' AS dtype FROM d" for c, t in (("l_linenumber", "int"), ("qty", "double"), ("l_returnflag", "string"))))
add("quality_score", MISS, lambda df: rounded(s.quality_score(df), "quality_score"), "+q AS (SELECT *, (2 + CASE WHEN qty IS NULL THEN 0 ELSE 1 END + CASE WHEN flag IS NULL THEN 0 ELSE 1 END + CASE WHEN rare IS NULL THEN 0 ELSE 1 END) / 5.0::DOUBLE * 10 AS x FROM d) SELECT l_orderkey, l_linenumber, qty, flag, rare, round(x, 4) AS quality_score, CASE WHEN x <= 4 THEN 'Poor' WHEN x <= 7 THEN 'Average' ELSE 'Good' END AS quality_category FROM q")
SUSP = View("part", "p_partkey", "CASE WHEN p_partkey % 5 = 0 THEN 20000.0 ELSE p_retailprice END AS price", "p_size * 4 AS age", "p_size % 8 AS rating")
add("suspicious_flags", SUSP, lambda df: s.detect_suspicious(df, keys=["p_partkey"]), "SELECT p_partkey, CAST(price % 10000 = 0 AS INT) AS price_suspiciously_round, CAST(age < 0 OR age > 120 AS INT) AS age_out_of_range, CAST(rating < 1 OR rating > 5 AS INT) AS rating_out_of_range FROM d")


def _overview(df: DataFrame) -> DataFrame:
    o = s.dataset_overview(df)
    return rows(df.sparkSession, [(x.column, x.dtype, int(x.non_nulls), int(x.nulls), float(x.missing_pct), int(x.unique_count)) for x in o.itertuples()], "column string, dtype string, non_nulls long, nulls long, missing_pct double, unique_count long")


add("overview", CAT, _overview, " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count({c}) AS non_nulls, count(*) - count({c}) AS nulls, round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS missing_pct, count(DISTINCT {c}) + CASE WHEN count(*) > count({c}) THEN 1 ELSE 0 END AS unique_count FROM d" for c, t in (("c_custkey", "bigint"), ("seg", "string"), ("nat", "string"))))


def _profile(df: DataFrame) -> DataFrame:
    p = s.profile_dataframe(df)["numeric_summary"]
    return rows(df.sparkSession, [(c, int(v["count"]), *(round(float(v[k]), 4) for k in ("mean", "std", "min", "25%", "50%", "75%", "max"))) for c, v in p.items()], "column string, n long, mean double, std double, low double, q25 double, q50 double, q75 double, high double")


add("profile_numeric", NUM, _profile, " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS low, round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75, CAST(max({c}) AS DOUBLE) AS high FROM d" for c in ("c_custkey", "x")))
OPT = View("lineitem", "l_orderkey", "l_linenumber", "l_linenumber - 4 AS signed", "l_quantity", "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_tax END AS tax", "l_returnflag")


def _labels(df: DataFrame) -> DataFrame:
    return rows(df.sparkSession, [(label, c) for label, cols in s.analyze_optimization(df).items() for c in cols], "label string, column string")


add("optimize_recommend", OPT, _labels, "SELECT CASE WHEN max(l_orderkey) < 256 THEN 'uint8' WHEN max(l_orderkey) < 65536 THEN 'uint16' WHEN max(l_orderkey) < 4294967296 THEN 'uint32' ELSE 'uint64' END AS label, 'l_orderkey' AS \"column\" FROM d UNION ALL VALUES ('uint8', 'l_linenumber'), ('int8', 'signed'), ('float32', 'l_quantity'), ('category', 'l_returnflag')")
add("optimize_narrow", OPT, lambda df: rows(df.sparkSession, sorted(narrow_types(df).items()), "column string, label string").where("column <> 'tax'"), "SELECT CASE WHEN max(l_orderkey) < 256 THEN 'uint8' WHEN max(l_orderkey) < 65536 THEN 'uint16' WHEN max(l_orderkey) < 4294967296 THEN 'uint32' ELSE 'uint64' END AS label, 'l_orderkey' AS \"column\" FROM d UNION ALL VALUES ('uint8', 'l_linenumber'), ('int8', 'signed'), ('float32', 'l_quantity')")
add("optimize_apply", OPT, lambda df: s.apply_optimization(df, s.analyze_optimization(df)).withColumns({"l_quantity": F.col("l_quantity").cast("double")}), "SELECT * FROM d")
add("optimize_dataset", OPT, lambda df: (lambda o: o.withColumns({c: F.round(F.col(c).cast("double"), 4) for c in numeric_columns(o)}))(s.optimize_dataset(df)), "SELECT CAST(l_orderkey AS DOUBLE) AS l_orderkey, CAST(l_linenumber AS DOUBLE) AS l_linenumber, CAST(signed AS DOUBLE) AS signed, round(l_quantity, 4) AS l_quantity, round(tax, 4) AS tax, l_returnflag FROM d")


def _csv(spark: SparkSession, sf_dir: str) -> str:
    out = scratch(spark, "csv") + ".csv"
    view = View("orders", "o_orderkey", "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS price", "CASE WHEN o_orderkey % 11 = 0 THEN 'N/A' ELSE o_orderpriority END AS p", "o_orderkey % 2 = 0 AS even")
    view.df(spark, sf_dir).write.option("header", True).csv(out)
    return out


_csv_sql = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS p, o_orderkey % 2 = 0 AS even FROM orders"


def _load_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.load_dataset(_csv(spark, sf_dir), type_map={"int64": ["o_orderkey"]}, spark=spark)


def _load_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, held = _csv(spark, sf_dir), scratch(spark, "cache")
    s.load_dataset(path, cache=True, cache_dir=held, spark=spark)
    return s.load_dataset(path, cache=True, cache_dir=held, spark=spark)


def _convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(io.convert_to_parquet(_csv(spark, sf_dir), scratch(spark, "parquet"), spark=spark))


def _convert_optimized(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spark.read.parquet(io.convert_to_parquet_optimized(_csv(spark, sf_dir), scratch(spark, "parquet"), "zstd", spark=spark))
    return out.withColumns({"o_orderkey": F.col("o_orderkey").cast("long"), "price": F.round(F.col("price").cast("double"), 0)})


LINES = View("orders", "o_orderkey", "concat(o_orderpriority, chr(10), 'said \"', o_orderstatus, '\", twice', chr(10), chr(10), 'end') AS note")


def _csv_lines(spark: SparkSession, sf_dir: str) -> str:
    out = scratch(spark, "csv") + ".csv"
    LINES.df(spark, sf_dir).write.option("header", True).option("escape", '"').csv(out)
    return out


def _load_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every chunk of a file read in chunks of 4,000 rows."""
    parts = list(io.load_csv(_csv(spark, sf_dir), chunksize=4000, spark=spark))
    out = None
    for i, part in enumerate(parts):
        one = part.agg(F.lit(i).cast("long").alias("chunk"), F.count(F.lit(1)).alias("n"), F.count("price").alias("prices"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(F.when(F.col("n") == 4000, "whole").otherwise("rest").alias("kind")).agg(F.count(F.lit(1)).alias("chunks"), F.sum("n").alias("n"))


QUERIES |= {
    "load_csv_cells_over_lines": lambda spark, sf_dir: io.load_csv(_csv_lines(spark, sf_dir), spark=spark),
    "convert_csv_cells_over_lines": lambda spark, sf_dir: spark.read.parquet(io.convert_to_parquet(_csv_lines(spark, sf_dir), scratch(spark, "parquet"), spark=spark)),
    "load_csv_chunks": _load_chunks,
}
ORACLES |= dict.fromkeys(("load_csv_cells_over_lines", "convert_csv_cells_over_lines"), LINES.sql)
ORACLES["load_csv_chunks"] = "SELECT 'whole' AS kind, count(*) // 4000 AS chunks, count(*) // 4000 * 4000 AS n FROM orders HAVING count(*) >= 4000 UNION ALL SELECT 'rest', 1, count(*) % 4000 FROM orders HAVING count(*) % 4000 > 0"
QUERIES |= {"load_csv": _load_csv, "load_csv_cached": _load_cached, "convert_to_parquet": _convert, "convert_to_parquet_optimized": _convert_optimized, "load_parquet": lambda spark, sf_dir: s.load_dataset(f"{sf_dir}/region.parquet", spark=spark)}
ORACLES |= {k: _csv_sql for k in ("load_csv", "load_csv_cached", "convert_to_parquet")}
ORACLES |= {"load_parquet": "SELECT * FROM region", "convert_to_parquet_optimized": _csv_sql.replace("o_totalprice END", "round(o_totalprice, 0) END")}



def _load_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV and Parquet with hints; one does not fit its column, which stays as it is."""
    out = scratch(spark, "typed")
    hints = {"datetime64[ns]": ["day"], "float32": ["price"], "int64": ["word"], "category": ["p"], "bool": ["absent"]}
    df = TYPED.df(spark, sf_dir)
    df.write.option("header", True).csv(f"{out}.csv")
    df.withColumns({c: F.col(c).cast("string") for c in ("day", "price")}).write.parquet(f"{out}.parquet")
    both = [s.load_dataset(f"{out}{kind}", type_map=hints, spark=spark).withColumn("kind", F.lit(kind)) for kind in (".csv", ".parquet")]
    one = both[0].unionByName(both[1])
    return one.select("kind", F.col("o_orderkey").cast("long").alias("o_orderkey"), F.date_format("day", "yyyy-MM-dd").alias("day"), F.round(F.col("price").cast("double"), 1).alias("price"), "p", "word")


TYPED = View("orders", "o_orderkey", "CAST(CAST(o_orderdate AS DATE) AS STRING) AS day", "o_orderkey % 64 / 2 AS price", "o_orderpriority AS p", "concat('w', CAST(o_orderkey AS STRING)) AS word")
QUERIES["load_types"] = _load_types
ORACLES["load_types"] = f"WITH d AS ({TYPED.sql}) SELECT kind, o_orderkey, day, round(CAST(price AS DOUBLE), 1) AS price, p, word FROM d, (VALUES ('.csv'), ('.parquet')) AS k(kind)"
NATION = View("nation", "n_nationkey", "n_name", "n_regionkey")


def _nation_csv(spark: SparkSession, sf_dir: str) -> str:
    out = scratch(spark, "nation") + ".csv"
    NATION.df(spark, sf_dir).coalesce(1).write.option("header", True).csv(out)
    return out


def _load_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small table loaded in each collected format, by either file kind and any engine name."""
    got = []
    for kind, path in (("csv", _nation_csv(spark, sf_dir)), ("parquet", f"{sf_dir}/nation.parquet")):
        for fmt in ("relation", "arrow", "pandas"):
            data = s.load_dataset(path, engine="polars", spark=spark, fetch_format=fmt)
            data = data.toPandas() if fmt == "relation" else data.to_pandas() if fmt == "arrow" else data
            got.append((kind, fmt, len(data), int(data["n_nationkey"].sum()), str(data["n_name"].min())))
    return rows(spark, got, "kind string, format string, n long, keys long, first_name string")


def _estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    mb = s.estimate_csv_memory(_nation_csv(spark, sf_dir), spark=spark)
    return rows(spark, [(round(mb * 2**20),)], "bytes long")


def _cli_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command line converts with and without narrower types."""
    path, out = _csv(spark, sf_dir), scratch(spark, "cli")
    with redirect_stdout(StringIO()):
        optimize_main([path, "--to-parquet", f"{out}-plain"])
        optimize_main([path, "--to-parquet", f"{out}-narrow", "--optimize", "--compression", "zstd"])
    both = [spark.read.parquet(f"{out}-{k}").select(F.lit(k).alias("kind"), F.col("o_orderkey").cast("long").alias("o_orderkey"), F.round(F.col("price").cast("double"), 0).alias("price"), "p", "even") for k in ("plain", "narrow")]
    return both[0].unionByName(both[1])


def _cli_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line that the profiling command prints, and how many columns it lists."""
    said = StringIO()
    with redirect_stdout(said):
        profile_main([f"{sf_dir}/orders.parquet"])
    first, _, *columns = said.getvalue().strip().splitlines()
    return rows(spark, [(int(first.split()[0]), int(first.split()[2]), len(columns))], "n long, columns long, listed long")


def _date_report(df: DataFrame) -> DataFrame:
    d = s.DateFeatureExtractor(["year", "is_weekend", "cyclical", "season"])
    d.transform(df)
    return rows(df.sparkSession, [tuple(r) for r in d.get_report()[["source", "feature", "type"]].itertuples(index=False)], "source string, feature string, type string")


def _optimize_report(df: DataFrame) -> DataFrame:
    types = {"uint8": ["l_linenumber"], "float32": ["l_quantity"], "int8": ["signed"]}
    with redirect_stdout(StringIO()):
        a, b, saved = s.optimization_report(df, s.apply_optimization(df, types), types)
    return rows(df.sparkSession, [(detect_engine(df), round(a * 2**20), round(b * 2**20), round(saved, 4))], "engine string, bytes_before long, bytes_after long, saved_pct double")


class Centred(s.FitTransformer):
    """A step of a user's own: a column less its mean."""

    def __init__(self, column: str):
        self.column, self.mean = column, 0.0

    def fit(self, df: DataFrame) -> Centred:
        self.mean = df.agg(F.avg(self.column)).first()[0] or 0.0
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.column, F.col(self.column) - F.lit(self.mean))

    def get_report(self) -> Any:
        return table([{"column": self.column, "mean": self.mean}], ["column", "mean"])


QUERIES |= {"load_formats": _load_formats, "estimate_csv_memory": _estimate, "cli_optimize": _cli_convert, "cli_profile": _cli_profile}
ORACLES |= {
    "load_formats": "SELECT kind, format, count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS keys, min(n_name) AS first_name FROM nation, (VALUES ('csv'), ('parquet')) AS k(kind), (VALUES ('relation'), ('arrow'), ('pandas')) AS f(format) GROUP BY kind, format",
    "estimate_csv_memory": "SELECT CAST(len('n_nationkey,n_name,n_regionkey') + 1 + sum(len(CAST(n_nationkey AS VARCHAR)) + strlen(n_name) + len(CAST(n_regionkey AS VARCHAR)) + 3) AS BIGINT) AS bytes FROM nation",
    "cli_optimize": f"WITH d AS ({_csv_sql}) SELECT kind, o_orderkey, round(price, 0) AS price, p, even FROM d, (VALUES ('plain'), ('narrow')) AS k(kind)",
    "cli_profile": "SELECT count(*) AS n, (SELECT count(*) FROM (DESCRIBE orders)) AS columns, (SELECT count(*) FROM (DESCRIBE orders)) AS listed FROM orders",
}
add("date_report", DATES, _date_report, "SELECT 'od' AS source, 'od_' || f AS feature, t AS type FROM (VALUES ('year', 'basic'), ('is_weekend', 'flag'), ('month_sin', 'cyclical'), ('month_cos', 'cyclical'), ('weekday_sin', 'cyclical'), ('weekday_cos', 'cyclical'), ('season', 'season')) AS v(f, t)")
SIZED = View("lineitem", "CAST(l_orderkey AS BIGINT) AS l_orderkey", "CAST(l_linenumber AS INT) AS l_linenumber", "CAST(l_linenumber - 4 AS INT) AS signed", "CAST(l_quantity AS DOUBLE) AS l_quantity", "l_returnflag")
add("optimize_report", SIZED, _optimize_report, "SELECT 'spark' AS engine, CAST(sum(32 + strlen(l_returnflag)) AS BIGINT) AS bytes_before, CAST(sum(23 + strlen(l_returnflag)) AS BIGINT) AS bytes_after, round((1 - sum(23 + strlen(l_returnflag))::DOUBLE / sum(32 + strlen(l_returnflag))) * 100, 4) AS saved_pct FROM d")
add("custom_transformer", NUM, lambda df: rounded(Centred("x").fit_transform(df), "x", to=2), "SELECT c_custkey, round(x - (SELECT avg(x) FROM d), 2) AS x FROM d")

# pipeline ------------------------------------------------------------------------------------------

PIPE = View(
    "orders", "o_orderkey", "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE concat('$', CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), '.5') END AS total",
    "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE concat(' ', lower(o_orderpriority), ' ') END AS pri", "o_custkey AS cust", "o_orderdate AS od",
)
_total = "CAST(replace(total, '$', '') AS DOUBLE)"


def _pipeline_default(df: DataFrame) -> DataFrame:
    out, _ = s.AutomatedCleaner(persist=False).clean(df)
    return rounded(out, "total", to=2)


add("pipeline_default", PIPE, _pipeline_default, f"+t AS (SELECT o_orderkey, {_total} AS total, pri, cust, od FROM d) SELECT o_orderkey, round(coalesce(total, (SELECT median(total) FROM t)), 2) AS total, coalesce(pri, (SELECT pri FROM t WHERE pri IS NOT NULL GROUP BY pri ORDER BY count(*) DESC, pri LIMIT 1)) AS pri, cust, od FROM t")


def _pipeline_full(df: DataFrame) -> DataFrame:
    cleaner = s.AutomatedCleaner(
        duplicate_handler=s.DuplicateHandler(order_by=["o_orderkey"]), duplicate_subset=["cust", "pri"], duplicate_survivorship="first", outlier_columns=["total"], outlier_threshold=0.2,
        column_types={"pri": "code"}, scale_method="minmax", extract_date_features=["year", "month"], add_missing_indicators=True,
        category_standardizer=s.CategoryStandardizer(mappings={"pri": {"1-URGENT": "TOP"}}),
    )
    out, _ = cleaner.clean(df)
    return rounded(out.select("total", "pri", "total_is_missing", "pri_is_missing", "od_year", "od_month", "o_orderkey"), "total", "od_year", "od_month", "o_orderkey", "total_is_missing", "pri_is_missing", to=6)


add("pipeline_full", PIPE, _pipeline_full, rf"""+a AS (SELECT o_orderkey, {_total} AS total, replace(regexp_replace(upper(trim(pri)), '\s+', '', 'g'), '1-URGENT', 'TOP') AS pri, cust, year(od) AS y, month(od) AS m FROM d),
    b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY cust, pri ORDER BY o_orderkey) = 1),
    q AS (SELECT quantile_cont(total, 0.25) AS q1, quantile_cont(total, 0.75) AS q3 FROM b),
    c AS (SELECT o_orderkey, least(greatest(total, q1 - 0.2 * (q3 - q1)), q3 + 0.2 * (q3 - q1)) AS capped, total, pri, y, m, CAST(total IS NULL AS INT) AS tm, CAST(pri IS NULL AS INT) AS pm FROM b, q),
    c2 AS (SELECT *, CASE WHEN total IS NULL THEN NULL ELSE capped END AS v FROM c),
    e AS (SELECT o_orderkey, coalesce(v, (SELECT median(v) FROM c2)) AS total, coalesce(pri, (SELECT pri FROM c2 WHERE pri IS NOT NULL GROUP BY pri ORDER BY count(*) DESC, pri LIMIT 1)) AS pri, y, m, tm, pm FROM c2),
    r AS (SELECT min(total) AS tl, max(total) - min(total) AS tr, min(y) AS yl, max(y) - min(y) AS yr, min(m) AS ml, max(m) - min(m) AS mr, min(o_orderkey) AS ol, max(o_orderkey) - min(o_orderkey) AS orr FROM e)
    SELECT round((total - tl) / tr, 6) AS total, pri, round(CAST(tm AS DOUBLE), 6) AS total_is_missing, round(CAST(pm AS DOUBLE), 6) AS pri_is_missing, round((y - yl) / yr::DOUBLE, 6) AS od_year, round((m - ml) / mr::DOUBLE, 6) AS od_month, round((o_orderkey - ol) / orr::DOUBLE, 6) AS o_orderkey FROM e, r""")


def _pipeline_report(df: DataFrame) -> DataFrame:
    _, report = s.AutomatedCleaner(persist=False).clean(df)
    v = report["validation"]
    return rows(df.sparkSession, [tuple(float(v[k]) for k in ("rows_before", "rows_after", "columns_before", "columns_after", "data_loss_pct", "missing_before", "missing_after"))], "rows_before double, rows_after double, columns_before double, columns_after double, data_loss_pct double, missing_before double, missing_after double")


add("pipeline_report", PIPE, _pipeline_report, "SELECT count(*)::DOUBLE AS rows_before, count(*)::DOUBLE AS rows_after, 5.0::DOUBLE AS columns_before, 5.0::DOUBLE AS columns_after, 0.0::DOUBLE AS data_loss_pct, (2 * count(*) - count(total) - count(pri))::DOUBLE AS missing_before, 0.0::DOUBLE AS missing_after FROM d")
