"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. Within a source, documents are ordered by that key; the
top bits of the key are the range they fall in. Sums of sizes for (source, range) give where each
range starts: a distributed prefix sum, made level by level, first over a source's coarse ranges,
then over the fine ranges of the coarse one that holds its cut. A source's budget is cut in
exactly one fine range; only that range's rows are ordered one by one. Documents
before the cut are taken once more than those after it, and the document on the cut in part, so
that each source gives its budget to the word. Budgets over a source's size repeat it in epochs.

No text is shuffled but that of rows in the one cut range of each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkscrub.llm.staging import stage

#: White space of a word count, as in ``[^\\x20\\x09-\\x0D]+``.
SPACE = " \t\n\x0b\x0c\r"
#: Levels of ranges: a source has 16**3 coarse and 16**6 fine ranges of its random keys, so that a level's
#: prefix sum is over 4096 rows at most, and the rows of a fine range are few in a source of any size.
RANGE_LEVELS = (3, 6)


def count_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null has none."""
    body = F.ltrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.length(F.regexp_replace(body, r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "x")).cast("long")


def source_targets(sizes: DataFrame, source_col: str, weights: DataFrame | None, max_epochs: int) -> DataFrame:
    """Per source: source_size and target.

    Weights are 1, 2, 3, repeating over the sources by code point, null last, or those given as
    (source, weight). Targets share the total by weight and stop at ``max_epochs`` times a source's
    size; what that leaves over is shared by weight among the others until none is above. One
    source can stop only if all with a smaller ratio of size to weight do, so that one ordered
    pass over the sources (a small table: one row each) finds who stops.
    """
    by_name = Window.orderBy(F.col(source_col).asc_nulls_last())
    per = sizes.groupBy(source_col).agg(F.sum("size").alias("source_size"))
    if weights is None:
        per = per.withColumn("w", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("long"))
    else:
        w = weights.select(F.col(source_col).alias("__s"), F.col("weight").alias("w"))
        per = per.join(w, F.col(source_col).eqNullSafe(F.col("__s")), "left").drop("__s").withColumn("w", F.coalesce("w", F.lit(0)))
    cap = F.when(F.col("w") > 0, F.col("source_size") * max_epochs).otherwise(0)
    order = Window.orderBy((F.when(F.col("w") > 0, cap / F.col("w"))).asc_nulls_first(), F.col(source_col).asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.sum("source_size").over(whole) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    per = per.withColumns({"rest": rest, "rest_w": F.sum("w").over(after)})
    stops = (F.col("w") == 0) | (F.col("rest").cast("double") * F.col("w") >= cap.cast("double") * F.col("rest_w"))
    per = per.withColumn("stops", stops)
    free = per.withColumn("open_rest", F.max(F.when(~F.col("stops"), F.col("rest"))).over(whole))
    free = free.withColumn("open_w", F.sum(F.when(~F.col("stops"), F.col("w")).otherwise(0)).over(whole))
    share = (F.col("open_rest") * F.col("w")).cast("double") / F.col("open_w")
    target = F.when(F.col("w") == 0, F.lit(0.0)).when(F.col("stops"), cap.cast("double")).otherwise(share)
    return free.select(source_col, "source_size", target.alias("target"))


def _cut_ranges(sums: DataFrame, budgets: DataFrame, source_col: str) -> DataFrame:
    """Per source with words: __src, the range __cut that holds its word ``__left``, and the words ``__at`` before that range."""
    at = budgets.select("__src", "__left", F.lit("").alias("__cut"), F.lit(0).cast("long").alias("__at"))
    before = Window.partitionBy("__src").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    for digits in RANGE_LEVELS:
        inside = sums.join(at, sums[source_col].eqNullSafe(at["__src"]) & F.col("__range").startswith(F.col("__cut")))
        parts = inside.groupBy("__src", "__left", "__at", F.left("__range", F.lit(digits)).alias("__part")).agg(F.sum("size").alias("size"))
        starts = parts.withColumn("__start", F.col("__at") + F.coalesce(F.sum("size").over(before), F.lit(0)))
        held = starts.where((F.col("__start") <= F.col("__left")) & (F.col("__left") < F.col("__start") + F.col("size")))
        at = held.select("__src", "__left", F.col("__part").alias("__cut"), F.col("__start").alias("__at"))
    return at


def mix_sources(
    docs: DataFrame, weights: DataFrame | None = None, max_epochs: int = 3, seed: str = "mix",
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """Every row of ``docs`` with size, source_size, target and taken (words, repeats counted).

    The random key is a hash of the seed and the id, so reruns agree. Null ids share one key; rows
    with equal keys are ordered by size. Null texts have size 0 and take nothing. A null source is
    a source. A source of size 0 has target 0. An empty table gives an empty result. Columns of
    ``docs`` that have the added names are replaced.
    """
    docs = docs.drop("size", "source_size", "target", "taken")
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    keyed = docs.withColumns({"size": count_words(F.col(text_col)), "__key": key, "__range": F.left(key, F.lit(RANGE_LEVELS[-1]))})
    sums = stage(keyed.groupBy(F.col(source_col), "__range").agg(F.sum("size").alias("size")), "mix-ranges")
    targets = source_targets(sums, source_col, weights, max_epochs)
    t = targets.withColumnRenamed(source_col, "__src")
    budget = F.floor("target")
    t = t.withColumn("__epochs", F.when(F.col("source_size") > 0, F.floor(F.expr("floor(target) div source_size"))).otherwise(0).cast("long"))
    t = t.withColumn("__left", (budget - F.col("__epochs") * F.col("source_size")).cast("long"))
    t = stage(t, "mix-budgets")
    at = _cut_ranges(sums, t, source_col).select(F.col("__src").alias("__c"), "__cut", "__at")
    cuts = t.join(at, F.col("__src").eqNullSafe(F.col("__c")), "left").drop("__c")
    cuts = stage(cuts, "mix-cuts")
    rows = keyed.join(cuts, keyed[source_col].eqNullSafe(cuts["__src"]), "left")
    plain = F.col("size") * (F.col("__epochs") + F.when(F.col("__range") < F.col("__cut"), 1).otherwise(0))
    on_cut = F.coalesce(F.col("__range") == F.col("__cut"), F.lit(False))
    order = Window.partitionBy(source_col).orderBy("__key", "size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("__at") + F.coalesce(F.sum("size").over(order), F.lit(0))
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("__left") - ahead))
    cut_rows = rows.where(on_cut).withColumn("taken", F.col("size") * F.col("__epochs") + part)
    out = rows.where(~on_cut).withColumn("taken", plain).unionByName(cut_rows)
    return out.select(*docs.columns, "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def taken_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows that the mix takes words of, with their columns and size, target, taken."""
    return mix_sources(docs, **options).where("taken > 0")
