"""Near-duplicates by MinHash with tensored banding; candidates are confirmed on full sets.

* A text's set is its distinct shingles of ``words`` words, as 64-bit hashes. Texts with one set, told by its size
  and 128 further bits, are one node.
* Two collections of GROUPS keys, each key made of WIDTH minimum hashes, take 2*GROUPS*WIDTH hash
  functions. Tables are formed by all pairs (key of the first, key of the second): GROUPS**2
  tables, each as selective as 2*WIDTH hashes. Two sets of similarity s meet in no table only if
  all keys of one collection differ: at most 2 * (1 - s**WIDTH)**GROUPS, 5e-5 at s = 0.8;
  they do meet with 0.06 at s = 0.4, 0.33 at 0.5 and 0.79 at 0.6, which only costs comparisons.
* Second keys are only joined to first keys that two nodes share: other tables cannot meet. One
  table of each first key is read before the others, whose edges within what it joined are not made.
* Nodes that meet, directly or over others, form a cluster. Within clusters every pair of sets
  that a link could still join is compared in full, in blocks of bounded size. Clusters over one
  block are first compared with one pivot; members linked to it need no comparison among
  themselves, only with those that are not.
* Links give components; no pairs are emitted but those of a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkscrub.llm.components import connected_components
from sparkscrub.llm.exact_dedup import text_digest
from sparkscrub.llm.staging import drop_rows, maybe_in, small_batches, stage
from sparkscrub.llm.words import U64, hash_words, mix, runs_of, starts_of

GROUPS, WIDTH = 27, 5
#: Shingles of one block of a cluster; two blocks are compared in one task.
BLOCK = 300_000


def shingle_sets(texts: list[bytes], words: int, lower: bool = True) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; with fewer words, the whole sequence as one."""
    (hashes,), owner = hash_words(texts, lower)
    at = starts_of(owner, len(texts))
    every = runs_of(hashes, words)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= words:
            out.append(np.unique(every[a : b - words + 1]))
        elif b > a:
            out.append(runs_of(hashes[a:b], int(b - a)))
        else:
            out.append(hashes[:0])
    return out


def set_id(s: np.ndarray) -> bytes:
    """128 bits that name a set."""
    a, b = mix(s).sum(dtype=U64), mix(s ^ U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=U64)
    return np.array([a, b ^ U64(len(s))], U64).tobytes()


def table_keys(sets: list[np.ndarray], groups: int = GROUPS, width: int = WIDTH) -> np.ndarray:
    """2*groups keys of each of some non-empty sets: the two collections side by side."""
    functions = np.random.default_rng(7).integers(0, 1 << 63, 2 * groups * width, dtype=U64) * U64(2) + U64(1)
    flat, sizes = np.concatenate(sets), np.array([len(s) for s in sets])
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    keys = np.zeros((len(sets), 2 * groups), U64)
    for f, a in enumerate(functions):
        low = np.minimum.reduceat((flat * a) >> U64(32), at)
        g = f // width
        keys[:, g] = mix(keys[:, g] * U64(0x9E3779B97F4A7C15) + low + U64(g))
    return keys


def _sketch(words: int, groups: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            sets = shingle_sets(texts, words)
            full = [i for i, s in enumerate(sets) if len(s)]
            keys = table_keys([sets[i] for i in full], groups, width).view(np.int64) if full else None
            first, second = [None] * len(sets), [None] * len(sets)
            for row, i in enumerate(full):
                first[i], second[i] = keys[row, :groups], keys[row, groups:]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_id(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array(first, pa.list_(pa.int64())), pa.array(second, pa.list_(pa.int64())),
                ],
                ["id", "digest", "n", "node", "first", "second"],
            )

    return run


def _full_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets([t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()], words)
            ids = [set_id(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["set_id", "shingles"])

    return run


def links_among(nodes: list[int], sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between sets marked ``left`` and sets marked ``right`` that join what is not yet joined.

    Postings of shingles give all intersection sizes of a set with the others at once.
    """
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    keep = right[owner]
    order = np.argsort(flat[keep], kind="stable")
    hashes, owner = flat[keep][order], owner[keep][order]
    out = []
    for i in np.flatnonzero(left):
        lo, hi = np.searchsorted(hashes, sets[i], "left"), np.searchsorted(hashes, sets[i], "right")
        some = hi > lo
        if not some.any():
            continue
        lo, n = lo[some], (hi - lo)[some]
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(sets))
        near = np.flatnonzero((both > 0) & (100 * both >= percent * (sizes + len(sets[i]) - both)))
        for j in near.tolist():
            a, b = root(int(i)), root(j)
            if a != b:
                parent[a] = b
                out.append((nodes[i], nodes[j]))
    return out


def _compare(percent: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        clusters: dict[int, dict[int, list]] = {}
        for cluster, node, side, shingles in zip(group["cluster"], group["node"], group["side"], group["shingles"], strict=True):
            clusters.setdefault(cluster, {}).setdefault(node, [0, shingles])[0] |= side
        out = []
        for members in clusters.values():
            side = np.array([m[0] for m in members.values()])
            sets = [np.frombuffer(m[1], U64) for m in members.values()]
            out += links_among(list(members), sets, (side & 1) > 0, (side & 2) > 0, percent)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _links(rows: DataFrame, percent: int) -> DataFrame:
    """rows (bin, cluster, node, side, shingles): links between sides 1 and 2 (3: both) of a cluster in a bin."""
    return rows.groupBy("bin").applyInPandas(_compare(percent), "a long, b long")


def _stars(rows: DataFrame) -> DataFrame:
    """rows (label, key): edges (a, b) from the smallest label of a key to its others."""
    rows = stage(rows, "near-tables")
    heads = rows.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("z")).where("a < z").select("key", "a")
    return rows.join(heads, "key").where("label <> a").select("a", F.col("label").alias("b")).distinct()


def _components(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str, block: int, digest: Column, groups: int = GROUPS, width: int = WIDTH) -> DataFrame:
    """id, digest, n, label (of the component; null without shingles), component_id and kept of every row; see ``near_duplicates``."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketched = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), digest.cast("binary").alias("digest"))
    sketch = stage(sketched.mapInArrow(_sketch(words, groups, width), "id long, digest binary, n long, node binary, first array<long>, second array<long>"), "near-sketch")
    nodes = sketch.where("n > 0").groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("first").alias("first"), F.first("second").alias("second"))
    nodes = nodes.withColumnRenamed("node", "set_id").withColumn("node", F.monotonically_increasing_id())
    nodes = stage(nodes, "near-nodes")  # once written, the numbers of nodes are fixed
    first = nodes.select("node", F.explode("first").alias("k1"))
    shared = first.groupBy("k1").agg(F.count("*").alias("c")).where("c > 1").select("k1")
    live = first.join(shared, "k1").groupBy("node").agg(F.collect_list("k1").alias("k1s"))
    live = stage(live.join(nodes.select("node", "second"), "node"), "near-live")
    # one table for each first key joins most of what belongs together ...
    some = live.select(F.col("node").alias("label"), "second", F.explode("k1s").alias("k1"))
    some = some.select("label", F.xxhash64("k1", F.col("second")[F.pmod("k1", F.lit(groups)).cast("int")]).alias("key"))
    early = connected_components(_stars(some)).withColumnRenamed("label", "joined")
    # ... so that the tables of all pairs of keys add edges only between what is still apart
    label = F.coalesce("joined", "node")
    every = live.join(early, "node", "left").select(label.alias("label"), F.explode("k1s").alias("k1"), "second")
    every = every.select("label", F.explode(F.transform("second", lambda k2: F.xxhash64("k1", k2))).alias("key"))
    late = connected_components(_stars(every)).select(F.col("node").alias("joined"), F.col("label").alias("late"))
    clusters = live.select("node").join(early, "node", "left").withColumn("joined", F.coalesce("joined", "node")).join(late, "joined", "left")
    clusters = clusters.select("node", F.coalesce("late", "joined").alias("label"))
    clusters = clusters.join(nodes.select("node", "set_id", "id", "n"), "node").withColumnRenamed("label", "cluster")
    many = clusters.groupBy("cluster").agg(F.count("*").alias("c")).where("c > 1").select("cluster")
    clusters = stage(clusters.join(many, "cluster"), "near-clusters")
    per = clusters.groupBy("cluster").agg(F.sum("n").alias("total"), F.min("node").alias("pivot"))
    per = per.withColumn("parts", F.ceil(F.col("total") / block).cast("int")).drop("total")
    members = stage(clusters.join(per, "cluster"), "near-members")

    wanted = maybe_in(texts, [F.col("id")], members, [F.col("id")])
    sets = wanted.select("text").mapInArrow(_full_sets(words), "set_id binary, shingles binary").where("set_id is not null")
    sets = sets.join(members.select("set_id"), "set_id", "left_semi").groupBy("set_id").agg(F.first("shingles").alias("shingles"))
    rows = stage(members.join(sets, "set_id").select("cluster", "node", "n", "parts", "pivot", "shingles"), "near-sets")
    bins = max(1, -(-(rows.where("parts = 1").agg(F.sum("n")).first()[0] or 0) // block))
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    small = rows.where("parts = 1").withColumn("bin", F.struct(F.pmod(F.xxhash64("cluster"), F.lit(bins)).alias("x"), F.lit(0).cast("long").alias("y"), F.lit(0).cast("long").alias("c")))
    links = stage(_links(small.select("bin", "cluster", "node", F.lit(3).alias("side"), "shingles"), percent), "near-links")
    large = rows.where("parts > 1")
    if large.limit(1).count():
        large = large.withColumn("part", part)
        pivots = large.where("node = pivot").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        key = lambda x, y: F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.col("cluster").alias("c"))
        star = large.select("cluster", "part", "node", F.lit(2).alias("side"), "shingles").unionByName(pivots.select("cluster", "part", "node", F.lit(1).alias("side"), "shingles"))
        star = stage(_links(star.withColumn("bin", key(F.col("part"), F.lit(-1))), percent), "near-star")
        joined = star.select(F.col("b").alias("node")).unionByName(star.select(F.col("a").alias("node"))).distinct().withColumn("in", F.lit(True))
        large = stage(large.join(joined, "node", "left").withColumn("in", F.coalesce("in", F.lit(False))), "near-large")
        # those outside are compared with all: their part x against each part y
        each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        out = large.where("not in").withColumn("other", each).select(key(F.col("part"), F.col("other")).alias("bin"), "cluster", "node", F.lit(1).alias("side"), "shingles")
        used = large.where("not in").select("cluster", F.col("part").alias("x")).distinct()
        to = large.join(used, "cluster").select(key(F.col("x"), F.col("part")).alias("bin"), "cluster", "node", F.lit(2).alias("side"), "shingles")
        rest = stage(_links(out.unionByName(to), percent), "near-rest")
        links = links.unionByName(star).unionByName(rest)
    labels = connected_components(links)
    named = nodes.select("node", "set_id", "id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    lowest = named.groupBy("label").agg(F.min("id").alias("component_id"))
    by_node = named.join(lowest, "label").select("set_id", "label", "component_id")
    out = sketch.select("id", "digest", "n", F.col("node").alias("set_id")).join(by_node, "set_id", "left")
    component = F.coalesce("component_id", "id")
    return out.select("id", "digest", "n", "label", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, groups: int = GROUPS, width: int = WIDTH) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (smallest id linked, directly or
    over others) and kept (the id is its component's).

    Sets are linked when 100 * intersection >= percent * union. Texts are split at white space and
    A-Z lower-cased. Null and empty texts have no shingles and are linked with nothing. Null ids
    are never a component's id unless it has no other; only then are their rows kept. Repeated rows each get
    a row. Columns other than id and text are not read. An empty table gives an empty result.
    """
    out = _components(docs, words, percent, id_col, text_col, block, F.lit(None), groups, width)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "kept")


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, that of its smallest id, with the columns of ``docs`` as they were.

    Rows are judged one by one: rows of one id with texts of other components stay. Where several rows of a
    component have its smallest id (repeated rows, or null ids only), one of them stays. Null and empty texts are
    linked with nothing and stay all. An empty table gives an empty result.
    """
    found = _components(docs, words, percent, id_col, text_col, BLOCK, text_digest(F.col(text_col)))
    rows = found.where("label is not null").groupBy("label", "id", "digest", "kept").agg(F.count(F.lit(1)).alias("n"))
    rows = stage(rows, "near-rows")
    lowest = rows.where("kept").groupBy("label").agg(F.min("digest").alias("lowest"), F.sum("n").alias("all")).where("all > 1").drop("all")
    several = rows.where("kept").join(lowest, "label")
    gone = rows.where("not kept").select("id", "digest").unionByName(several.where("digest <> lowest").select("id", "digest"))
    once = several.where("digest = lowest and n > 1").select("id", "digest")
    return drop_rows(docs, [F.col(id_col).cast("long"), text_digest(F.col(text_col))], gone, once)
