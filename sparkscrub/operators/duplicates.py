"""Exact and fuzzy duplicates with survivorship rules."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from itertools import combinations
from math import ceil, comb

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkscrub.functions.missing import FLOATING, col, is_missing, known
from sparkscrub.operators.base import BaseTransformer, table
from sparkscrub.plans.order import ROW, numbered, with_row_id
from sparkscrub.plans.scratch import written

#: Different rows of a block that are compared with each other, or with as many others, in one task.
PIECE_ROWS = 1000
#: Classes of characters that are counted to bound a similarity from above.
CLASSES = 64
#: Parts of a cell by which rows of a large block may meet; different cells of the other columns that are put into classes; similar pairs that one task settles, as a stream.
CELL_PARTS, CLASS_ROWS, TASK_EDGES = 100, 2000, 100_000_000
#: Rows with a part that are gone through at once; pairs compared at once; longest cells that are compared many at once, ASCII only.
MEET_ROWS, MEET_PAIRS, MEET_LENGTH = 50_000, 16_384, 100


@dataclass
class DuplicateReport:
    duplicates_found: int
    groups: int
    rows_before: int
    rows_after: int
    rows_removed: int
    method: str
    survivorship: str


def string_similarity(a: str | None, b: str | None) -> float:
    """Ratcliff-Obershelp ratio of the lower-case strings; it depends on their order. Null: 0."""
    return 0.0 if a is None or b is None else SequenceMatcher(None, str(a).lower(), str(b).lower()).ratio()


def row_similarity(a: tuple, b: tuple) -> float:
    return sum(map(string_similarity, a, b)) / len(a) if a else 0.0


def _counts(cells: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Per row and column, how often each class of characters occurs, and the length (-1: null)."""
    k = len(cells[0]) if cells else 0
    counts, sizes = np.zeros((len(cells), k, CLASSES), np.int32), np.full((len(cells), k), -1)
    for i, row in enumerate(cells):
        for j, v in enumerate(row):
            if v is not None:
                codes = np.frombuffer(v.lower().encode("utf-32-le", "surrogatepass"), np.uint32) % CLASSES
                counts[i, j], sizes[i, j] = np.bincount(codes, minlength=CLASSES), len(codes)
    return counts, sizes


def _similar(a: list[tuple], b: list[tuple], threshold: float, wanted) -> Iterator[tuple[int, int, float]]:
    """(i, j, similarity) of the pairs of rows with ``wanted(i)[j]`` whose similarity reaches ``threshold``, by i; ``wanted`` is asked when i's turn comes.

    A ratio is at most twice the characters in common, whatever their order, over all characters; only pairs that
    this bound lets through are compared in full.
    """
    if not a or not b:
        return
    (ca, sa), (cb, sb) = _counts(a), _counts(b)
    for i in range(len(a)):
        some = np.flatnonzero(wanted(i))
        both = np.minimum(ca[i], cb[some]).sum(2)
        total = np.maximum(sa[i], 0) + np.maximum(sb[some], 0)
        bound = np.where(total > 0, 2 * both / np.maximum(total, 1), 1.0) * ((sa[i] >= 0) & (sb[some] >= 0))
        for j in some[bound.mean(1) >= threshold - 1e-9].tolist():
            if (s := row_similarity(a[i], b[j])) >= threshold:
                yield i, j, s


def _cells(group: pd.DataFrame, k: int) -> list[tuple]:
    return list(zip(*[[None if pd.isna(v) else v for v in group[f"m{i}"]] for i in range(k)], strict=True)) if k else [()] * len(group)


def _compared(k: int, threshold: float):
    """Edges (a, b, score) from the earlier to the later of similar rows of one or two pieces of a block."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        left, right = group[group["piece"] == group["x"]], group[group["piece"] == group["y"]]
        pos, other = left["pos"].to_numpy(), right["pos"].to_numpy()
        a, b = _cells(left, k), _cells(right, k)
        same = len(group) and group["x"].iloc[0] == group["y"].iloc[0]
        out = [(pos[i], other[j], s) for i, j, s in _similar(a, b, threshold, lambda i: other > pos[i])]
        if not same:
            out += [(other[j], pos[i], s) for j, i, s in _similar(b, a, threshold, lambda j: pos > other[j])]
        return pd.DataFrame(out, columns=["a", "b", "score"]).astype({"a": "int64", "b": "int64", "score": "float64"})

    return run


def _greedy(k: int, threshold: float):
    """(pos, seed, score) of what is gathered among the rows of a group, and of its seeds (themselves)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        cells, pos = _cells(group, k), group["pos"].to_numpy()
        seed, score, place = np.arange(len(cells)), np.ones(len(cells)), np.arange(len(cells))
        # what is gathered gathers nothing
        for i, j, s in _similar(cells, cells, threshold, lambda i: (place > i) & (seed == place) & (seed[i] == i)):
            seed[j], score[j] = i, s
        return pd.DataFrame({"pos": pos, "seed": pos[seed], "score": score}).astype({"pos": "int64", "seed": "int64", "score": "float64"})

    return run


def _gathered(k: int, threshold: float):
    """(pos, seed, score) of the rows of a slice that one of the seeds gathers: the first that is similar."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        seeds, rest = group[group["is_seed"]].sort_values("pos"), group[~group["is_seed"]]
        pos, other = seeds["pos"].to_numpy(), rest["pos"].to_numpy()
        by, score = np.full(len(rest), -1), np.zeros(len(rest))
        for i, j, s in _similar(_cells(seeds, k), _cells(rest, k), threshold, lambda i: by < 0):
            by[j], score[j] = i, s
        got = by >= 0
        return pd.DataFrame({"pos": other[got], "seed": pos[by[got]], "score": score[got]}).astype({"pos": "int64", "seed": "int64", "score": "float64"})

    return run


def _parts(lengths: list[int], least: float) -> dict[int, list[tuple[int, int, int]]] | None:
    """Per length of a cell, (shorter, longer, size): cells of these two lengths whose ratio reaches ``least`` have a part of ``size`` characters in common, in order.

    None where a cell has more than CELL_PARTS such parts, or nothing is excluded.
    """
    out: dict[int, list[tuple[int, int, int]]] = {}
    if least <= 0 or len(lengths) > CELL_PARTS:
        return None
    for n in lengths:
        sizes = [(min(n, m), max(n, m), ceil(least * (n + m) / 2 - 1e-6)) for m in lengths]
        out[n] = [x for x in sizes if x[2] <= x[0]]
        if sum(comb(n, x[2]) for x in out[n]) > CELL_PARTS:
            return None
    return out


def _parted(parts: dict[int, list[tuple[int, int, int]]], names: list[str]):
    """Rows (``names``) with a number for each part of their key cell, and whether the part is for cells of one length (0) or for shorter (1) and longer ones (2).

    Different parts may get the same number; what meets is compared in full.
    """
    base = np.uint64(0x9E3779B97F4A7C15)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, team = batch.column("cell").to_pylist(), batch.column("team").to_numpy().astype(np.uint64)
            lengths = np.array([len(v) for v in cells], int)
            at, found, side = [np.zeros(0, int)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int8)]
            for n in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == n)
                codes = np.frombuffer("".join([cells[i] for i in rows]).encode("ascii"), np.uint8).reshape(len(rows), n).T.astype(np.uint64)
                for lo, hi, size in parts[n]:
                    made = np.empty((comb(n, size), len(rows)), np.uint64)
                    for x, places in enumerate(combinations(range(n), size)):
                        h = team[rows] * np.uint64(0xD6E8FEB86659FD93) + np.uint64(lo * 65_537 + hi)
                        for p in places:
                            h = (h + codes[p] + np.uint64(1)) * base
                        made[x] = h ^ (h >> np.uint64(29))
                    made.sort(axis=0)
                    new = np.ones(made.shape, bool)
                    new[1:] = made[1:] != made[:-1]
                    own = np.broadcast_to(rows, made.shape)[new]
                    at.append(own)
                    found.append(made[new])
                    side.append(np.full(len(own), 0 if lo == hi else 1 if n == lo else 2, np.int8))
            taken = batch.select([c for c in names if c not in ("part", "side")]).take(pa.array(np.concatenate(at)))
            made = {"part": pa.array(np.concatenate(found).view(np.int64)), "side": pa.array(np.concatenate(side))}
            yield pa.RecordBatch.from_arrays([made[c] if c in made else taken.column(c) for c in names], names=names)

    return run


def _in_common(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Characters in the matching blocks of SequenceMatcher, of many pairs at once: the longest block, the earliest of those, then what is left and right of it.

    Cells are columns of ASCII codes, not longer than MEET_LENGTH.
    """
    out = np.zeros(len(la), np.int64)
    p, a0, a1, b0, b1 = np.arange(len(la)), np.zeros_like(la), la, np.zeros_like(lb), lb
    while len(p):
        ia, ib = a0 + np.arange((a1 - a0).max())[:, None], b0 + np.arange((b1 - b0).max())[:, None]
        x = np.where(ia < a1, a[np.minimum(ia, len(a) - 1), p], 254).astype(np.uint8)
        y = np.where(ib < b1, b[np.minimum(ib, len(b) - 1), p], 255).astype(np.uint8)
        run = np.zeros((len(y) + 1, len(p)), np.uint8)
        # of equal runs that end at one place of a, the first of b
        early = (255 - np.arange(len(y), dtype=np.uint16))[:, None]
        best, end = np.zeros(len(p), np.uint16), np.zeros(len(p), np.int64)
        for i in range(len(x)):
            new = np.zeros_like(run)
            np.multiply(run[:-1] + np.uint8(1), y == x[i], out=new[1:])
            run = new
            top = ((run[1:].astype(np.uint16) << np.uint16(8)) | early).max(axis=0)
            more = (top >> 8) > (best >> 8)
            best, end = np.where(more, top, best), np.where(more, i, end)
        size = (best >> 8).astype(np.int64)
        ea, eb = a0 + end + 1, b0 + 255 - (best & 255).astype(np.int64) + 1
        out += np.bincount(p, size, len(out)).astype(np.int64)
        p, a0, a1, b0, b1 = (np.concatenate(v) for v in ((p, p), (a0, ea), (ea - size, a1), (b0, eb), (eb - size, b1)))
        some = np.concatenate([size > 0, size > 0]) & (a1 > a0) & (b1 > b0)
        p, a0, a1, b0, b1 = p[some], a0[some], a1[some], b0[some], b1[some]
    return out


class _Cells:
    """Cells of a column, of which many pairs are compared at once."""

    def __init__(self, column: pa.ChunkedArray):
        coded = column.combine_chunks().dictionary_encode()
        self.codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        self.values = [v.lower() for v in coded.dictionary.to_pylist()]
        self.sizes = np.array([len(v) for v in self.values], int)
        short = [v.isascii() and len(v) <= MEET_LENGTH for v in self.values]
        self.short, width = np.array(short, bool), max([len(v) for v, ok in zip(self.values, short, strict=True) if ok], default=0)
        text = "".join([v.ljust(width) if ok else " " * width for v, ok in zip(self.values, short, strict=True)])
        self.chars = np.ascontiguousarray(np.frombuffer(text.encode("ascii"), np.uint8).reshape(len(self.values), width).T)

    def ratios(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """``string_similarity`` of the cells of rows x and y."""
        x, y = self.codes[x], self.codes[y]
        out = np.where((x == y) & (x >= 0), 1.0, 0.0)
        other = np.flatnonzero((x != y) & (x >= 0) & (y >= 0))
        pairs, back = x[other].astype(np.int64) * len(self.values) + y[other], slice(None)
        if len(self.values) ** 2 < len(other):
            pairs, back = np.unique(pairs, return_inverse=True)
        x, y = pairs // max(len(self.values), 1), pairs % max(len(self.values), 1)
        ratio, both, total = np.zeros(len(pairs)), self.short[x] & self.short[y], self.sizes[x] + self.sizes[y]
        for i in np.flatnonzero(~both).tolist():
            ratio[i] = string_similarity(self.values[x[i]], self.values[y[i]])
        some = np.flatnonzero(both & (self.sizes[x] > 0) & (self.sizes[y] > 0))
        for i in range(0, len(some), MEET_PAIRS):
            at = some[i : i + MEET_PAIRS]
            ratio[at] = 2.0 * _in_common(self.chars[:, x[at]], self.sizes[x[at]], self.chars[:, y[at]], self.sizes[y[at]]) / total[at]
        ratio[both & (total == 0)] = 1.0
        out[other] = ratio[back]
        return out


def _met(k: int, threshold: float):
    """Edges (team, a, b, score) of those rows of one team that have a part in common and are similar; rows come in order of part and pos."""

    def among(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        part, pos, team, side = (rows[c].to_numpy() for c in ("part", "pos", "team", "side"))
        ends = np.append(np.flatnonzero(part[1:] != part[:-1]) + 1, len(part))
        later = ends[np.searchsorted(ends, np.arange(len(part)), "right")] - np.arange(len(part)) - 1
        upto, cells, start = np.cumsum(later), [_Cells(rows[f"m{i}"]) for i in range(k)], 0
        while start < len(part):
            before = upto[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(upto, before + MEET_PAIRS * 8, "right")))
            n = later[start:stop]
            x = np.repeat(np.arange(start, stop), n)
            y = x + 1 + np.arange(len(x)) - np.repeat(upto[start:stop] - n - before, n)
            start = stop
            # numbers of parts may be equal by chance
            ok = (team[x] == team[y]) & (pos[x] != pos[y]) & ((side[x] == 0) | (side[x] != side[y]))
            x, y = x[ok], y[ok]
            ratio = [c.ratios(x, y) for c in cells]
            score = sum(ratio, np.zeros(len(x))) / k
            good = score >= threshold
            x, y = x[good], y[good]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (team[x], pos[x], pos[y], score[good])], names=["team", "a", "b", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= MEET_ROWS:
                rows = pa.Table.from_batches(held)
                # the last part may go on
                cut = pc.index(rows["part"], rows["part"][n - 1]).as_py()
                if cut:
                    yield from among(rows[:cut])
                held, n = rows[cut:].to_batches(), n - cut
        if n:
            yield from among(pa.Table.from_batches(held))

    return run


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pos, seed, score) of what is gathered, by edges that come in order: a row that is not gathered when its edges come gathers what is not gathered yet.

    A byte for each row is all that is held.
    """
    gathered = np.zeros(0, bool)
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, score = (batch.column(c).to_numpy() for c in ("a", "b", "score"))
        if (most := int(b.max())) >= len(gathered):
            gathered = np.append(gathered, np.zeros(most + 1, bool))
        starts = np.append(0, np.flatnonzero(a[1:] != a[:-1]) + 1)
        ends, found = np.append(starts[1:], len(a)), []
        free = np.flatnonzero(~gathered[a[starts]])
        for i, j in zip(starts[free].tolist(), ends[free].tolist(), strict=True):
            if not gathered[a[i]]:
                to, first = np.unique(b[i:j], return_index=True)
                found.append(i + first[~gathered[to]])
                gathered[to] = True
        at = np.concatenate(found) if found else np.zeros(0, int)
        yield pa.RecordBatch.from_arrays([pa.array(v[at]) for v in (b, a, score)], names=["pos", "seed", "score"])


def _in_order(edges: DataFrame) -> DataFrame:
    """(pos, seed, score) of rows that are gathered. Edges of a team, or all without teams, are gone through in order by one task."""
    teams = edges if "team" in edges.columns else edges.withColumn("team", F.lit(0).cast("long"))
    return teams.repartition("team").sortWithinPartitions("a", "b").select("a", "b", "score").mapInArrow(_settled, "pos long, seed long, score double")


def _seeds(edges: DataFrame) -> DataFrame:
    """Rows (node) that gather others when rows are taken in order and each that is not yet gathered gathers the later ones it has edges to.

    In rounds: what has no earlier open neighbour gathers, and what it has edges to is gathered. The last TASK_EDGES pairs are gone through in order.
    """
    open_ = edges
    seeds = None
    while n := open_.count():
        if n <= TASK_EDGES:
            last = written(_in_order(open_).select(F.col("seed").alias("node")).distinct(), "fuzzy-seeds")
            return last if seeds is None else seeds.unionByName(last)
        new = written(open_.select(F.col("a").alias("node")).distinct().join(open_.select(F.col("b").alias("node")), "node", "left_anti"), "fuzzy-seeds")
        seeds = new if seeds is None else seeds.unionByName(new)
        gathered = open_.join(new, open_["a"] == new["node"], "left_semi").select(F.col("b").alias("node")).distinct()
        done = written(gathered.unionByName(new), "fuzzy-done")
        left = open_.join(done, open_["a"] == done["node"], "left_anti")
        open_ = written(left.join(done, left["b"] == done["node"], "left_anti"), "fuzzy-open")
    return seeds if seeds is not None else edges.select(F.col("a").alias("node")).limit(0)


def _classes(nodes: DataFrame, names: list[str], k: int, threshold: float) -> Column:
    """A number by the cells of some of the k match columns: rows with different numbers are not similar. 0 for all where there are many different cells."""
    if not names:
        return F.lit(0)
    found = [tuple(r) for r in nodes.select(*names).distinct().limit(CLASS_ROWS + 1).collect()]
    if len(found) > CLASS_ROWS:
        return F.lit(0)
    group = list(range(len(found)))
    counts, sizes = _counts(found)
    for i in range(len(found)):
        both = np.minimum(counts[i], counts).sum(2)
        total = np.maximum(sizes[i], 0) + np.maximum(sizes, 0)
        bound = np.where(total > 0, 2 * both / np.maximum(total, 1), 1.0) * ((sizes[i] >= 0) & (sizes >= 0))
        near = {group[j] for j in np.flatnonzero(bound.sum(1) >= k * threshold - (k - len(names)) - 1e-9)} | {group[i]}
        if len(near) > 1:
            group = [min(near) if g in near else g for g in group]
    if len(set(group)) < 2:
        return F.lit(0)
    numbers = F.create_map(*[x for cells, g in zip(found, group, strict=True) for x in (F.to_json(F.array(*[F.lit(v).cast("string") for v in cells])), F.lit(g))])
    return F.element_at(numbers, F.to_json(F.array(*[F.col(c) for c in names])))


class DuplicateHandler(BaseTransformer):
    """Find duplicate groups, then keep one row of each.

    Row order is that of ``order_by`` or, without it, that in which the source is read.
    """

    def __init__(self, order_by: list[str] | None = None):
        self.order_by = order_by
        self._keys: list[str] | None = None
        self._fuzzy: DataFrame | None = None
        self._method, self._survivorship, self._counts = "none", "", None

    def _order(self, df: DataFrame) -> tuple[DataFrame, Column]:
        if self.order_by:
            rest = [f.name for f in df.schema.fields if f.name not in self.order_by and not isinstance(f.dataType, (T.MapType, T.VariantType))]
            return df, F.struct(*[col(c) for c in [*self.order_by, *rest]])
        return with_row_id(df), F.col(ROW)

    def find_exact(self, df: DataFrame, subset: list[str] | None = None) -> DataFrame:
        """Groups of rows with equal keys (nulls are equal): the keys, group_id in key order, and size.

        Groups are found and numbered at once, without a task that sees them all; ``transform`` finds its own.
        """
        self._keys, self._fuzzy, self._method = list(subset or df.columns), None, "exact"
        groups = df.groupBy(*self._key_columns(df)).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        return numbered(groups, [col(k).asc_nulls_last() for k in self._keys], "group_id")

    def exact_members(self, df: DataFrame, subset: list[str] | None = None) -> DataFrame:
        """The rows of each group that ``find_exact`` finds: (group_id, row_id, score, match_type) and the columns of ``df``.

        ``row_id`` is the ordinal of a row as read; all scores are 1.
        """
        groups = self.find_exact(df, subset).drop("size")
        groups = groups.select(*[col(k).alias(f"__k{i}") for i, k in enumerate(self._keys)], "group_id")
        rows = written(with_row_id(df), "rows")
        keys = self._key_columns(rows)
        on = F.lit(True)
        for i, c in enumerate(keys):
            on = on & c.eqNullSafe(F.col(f"__k{i}"))
        names = [col(c) for c in df.columns if c != ROW]
        return rows.join(groups, on).select("group_id", F.col(ROW).alias("row_id"), F.lit(1.0).alias("score"), F.lit("exact").alias("match_type"), *names)

    def _key_columns(self, df: DataFrame) -> list[Column]:
        return [known(k, df.schema[k].dataType).alias(k) if isinstance(df.schema[k].dataType, FLOATING) else col(k) for k in self._keys or []]

    def find_fuzzy(self, df: DataFrame, match_columns: list[str], threshold: float = 0.85, blocking_column: str | None = None, piece_rows: int = PIECE_ROWS) -> DataFrame:
        """Greedy groups within blocks: (group_id, row_id, score, match_type).

        Rows of a block are taken in order; each that is not yet matched gathers the later ones, not
        yet matched, whose mean similarity to it reaches ``threshold``. Rows with equal cells are one for
        that. In a block of more than ``piece_rows`` different rows, rows are compared that share such a part of a cell as similar rows have to
        share. Where such parts are many or exclude little, the first ``piece_rows`` different rows gather first; what families of similar
        rows leave is compared in pieces, each with each, and who gathers whom is settled by going through the similar
        pairs in order: the work grows with the square of a block's dissimilar rows, the memory of a task does not. Rows are written with their ordinals first, so that results
        belong to the rows they were found for.
        """
        self._keys, self._method = None, "fuzzy"
        self._asked = {"match_columns": list(match_columns), "threshold": threshold, "blocking_column": blocking_column, "piece_rows": piece_rows}
        names = [c for c in match_columns if c in df.columns]
        self._found_in, k = df, len(names)
        self._ids = base = written(with_row_id(df), "rows")
        block = col(blocking_column).cast("string") if blocking_column in df.columns else F.lit("")
        order = self._order(base)[1]
        rows = base.select(block.alias("block"), F.col(ROW).alias("row_id"), *[col(c).cast("string").alias(f"m{i}") for i, c in enumerate(names)], order.alias("o"))
        cells = ["block", *[f"m{i}" for i in range(k)]]
        nodes = rows.groupBy(*cells).agg(F.min(F.struct("o", "row_id")).alias("first"), F.count(F.lit(1)).alias("n"))
        nodes = numbered(nodes.select(*cells, "n", F.col("first.o").alias("o"), F.col("first.row_id").alias("first")), [F.col("o"), F.col("first")], "pos").drop("o")
        nodes = written(nodes, "fuzzy-nodes")
        large = nodes.groupBy(F.col("block").alias("__b")).agg(F.count(F.lit(1)).alias("rows"), F.min("pos").alias("__at")).where(F.col("rows") > piece_rows)
        large = written(large, "fuzzy-large")
        inside = F.col("block").eqNullSafe(F.col("__b"))
        taken = self._by_parts(nodes.join(large, inside).drop("__b", "rows"), cells, threshold, piece_rows)
        others = nodes if taken is None else nodes.join(large, inside, "left_anti")
        if taken is None or not others.isEmpty():
            first, rest = self._by_first(others, cells, threshold, piece_rows)
            taken = first if taken is None else taken.unionByName(first)
            if rest is not None:
                taken = taken.unionByName(self._by_pieces(rest, cells, threshold, piece_rows))
        taken = written(taken, "fuzzy-taken")
        seeds = taken.where("seed <> pos").select(F.col("seed").alias("node")).distinct()
        taken = taken.where("seed <> pos")
        alike = sum((F.when(F.col(c).isNull(), 0.0).otherwise(1.0) for c in cells[1:]), F.lit(0.0)) / max(k, 1)
        owned = nodes.withColumn("alike", alike).join(taken, "pos", "left").join(seeds.select(F.col("node").alias("pos"), F.lit(True).alias("gathers")), "pos", "left")
        owned = owned.where("seed is not null or gathers").unionByName(owned.where(F.col("seed").isNull() & F.col("gathers").isNull() & (F.col("n") > 1) & (F.col("alike") >= threshold)))
        firsts = nodes.select(F.col("pos").alias("__pos"), F.col("first").alias("group_id"))
        owned = owned.join(firsts, F.coalesce("seed", "pos") == F.col("__pos")).select(*[F.col(c).alias(f"__{c}") for c in cells], "group_id", "first", "score", "alike")
        on = F.lit(True)
        for c in cells:
            on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
        score = F.when(F.col("row_id") == F.col("group_id"), 1.0).otherwise(F.coalesce("score", "alike"))
        found = rows.join(owned, on).withColumn("score", score).where(F.col("score") >= threshold)
        self._fuzzy = written(found.select("group_id", "row_id", "score", F.lit("fuzzy").alias("match_type")), "fuzzy-groups")
        return self._fuzzy

    @staticmethod
    def _by_first(nodes: DataFrame, cells: list[str], threshold: float, piece_rows: int) -> tuple[DataFrame, DataFrame | None]:
        """What the first rows of each block gather, (pos, seed, score), and the rows that are then left.

        Again while that leaves less than half: families of similar rows go in a few passes over the block. A block
        that fits into one piece is settled here as a whole.
        """
        k, out, left = len(cells) - 1, None, nodes.select("pos", *cells)
        while True:
            left = numbered(left, [F.col("block"), F.col("pos")], "at")
            low = left.groupBy(F.col("block").alias("__b")).agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("rows"))
            left = written(left.join(low, F.col("block").eqNullSafe(F.col("__b"))).withColumn("first", F.col("at") - F.col("low") < piece_rows).drop("at", "low", "__b"), "fuzzy-left")
            head = written(left.where("first").groupBy("block").applyInPandas(_greedy(k, threshold), "pos long, seed long, score double"), "fuzzy-head")
            seeds = left.where("first").join(head.where("pos = seed").select("pos"), "pos", "left_semi")
            slices = F.ceil(F.col("rows") / piece_rows).cast("int")
            each = seeds.withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1))).withColumn("is_seed", F.lit(True))
            later = left.where("not first").withColumn("slice", F.pmod(F.xxhash64("pos"), slices).cast("int")).withColumn("is_seed", F.lit(False))
            both = later.unionByName(each).select("block", "slice", "pos", "is_seed", *cells[1:])
            found = written(both.groupBy("block", "slice").applyInPandas(_gathered(k, threshold), "pos long, seed long, score double"), "fuzzy-found")
            new = head.unionByName(found)
            out = new if out is None else out.unionByName(new)
            before = left.where("not first").count()
            if not before:
                return out, None
            left = written(left.where("not first").join(found.select("pos"), "pos", "left_anti").select("pos", *cells), "fuzzy-left")
            after = left.count()
            if not after:
                return out, None
            if 2 * after > before:
                return out, left

    @staticmethod
    def _by_pieces(nodes: DataFrame, cells: list[str], threshold: float, piece_rows: int) -> DataFrame:
        """(pos, seed, score) of rows that are gathered, by comparing all pieces of a block with each other."""
        sizes = nodes.groupBy(F.col("block").alias("__b")).agg(F.ceil(F.count(F.lit(1)) / piece_rows).cast("int").alias("pieces"))
        dealt = nodes.join(sizes, F.col("block").eqNullSafe(F.col("__b"))).withColumn("piece", F.pmod(F.xxhash64("pos"), F.col("pieces")).cast("int"))
        each = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        each = each.select("block", F.least("piece", "other").alias("x"), F.greatest("piece", "other").alias("y"), "piece", "pos", *cells[1:])
        return DuplicateHandler._by_edges(written(each.groupBy("block", "x", "y").applyInPandas(_compared(len(cells) - 1, threshold), "a long, b long, score double"), "fuzzy-edges"))

    @staticmethod
    def _by_parts(nodes: DataFrame, cells: list[str], threshold: float, piece_rows: int) -> DataFrame | None:
        """(pos, seed, score) of rows that are gathered, by comparing rows that share a part of a cell; None where that excludes too little.

        With a mean of ``threshold`` no column's ratio is below a bound, and a ratio is made of characters that both
        cells hold in the same order: similar rows share one of the parts of that size of their cells. Parts are taken from the column
        with the most different cells. Few different cells of the other columns are put into classes between which nothing is similar.
        """
        k = len(cells) - 1
        least = k * threshold - (k - 1)
        if not k or least <= 0 or nodes.isEmpty():
            return None
        spread = nodes.agg(*[F.approx_count_distinct(c) for c in cells[1:]]).first()
        key = cells[1:][max(range(k), key=lambda i: spread[i])]
        rest = [c for c in cells[1:] if c != key]
        known_ = nodes.where(F.col(key).isNotNull())  # a null is similar to nothing
        lengths = [r[0] for r in known_.select(F.length(F.lower(key))).distinct().limit(CELL_PARTS + 1).collect()]
        # lower case may be longer or shorter in Python, which tells lengths where a row is made
        if known_.where(F.col(key).rlike("[^\\x00-\\x7f]")).isEmpty():
            parts = _parts(sorted(lengths), least)
        else:
            parts = None
        if parts is None:
            return None
        # rows of different blocks or classes are of different teams
        team = F.col("__at") * (2 * CLASS_ROWS) + _classes(known_, rest, k, threshold)
        named = known_.select(team.cast("long").alias("team"), "pos", *cells[1:], F.lower(key).alias("cell"))
        numbers = named.select("team", "cell").mapInArrow(_parted(parts, ["part"]), "part long").groupBy("part").agg(F.count(F.lit(1)).alias("n"))
        met, most = numbers.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.max("n")).first()
        n = known_.count()
        if met and (most > piece_rows or met > n * n / 20):
            return None
        names = ["part", "side", "team", "pos", *cells[1:]]
        keys = named.mapInArrow(_parted(parts, names), f"part long, side byte, team long, pos long, {', '.join(f'{c} string' for c in cells[1:])}")
        edges = keys.repartition("part").sortWithinPartitions("part", "pos").mapInArrow(_met(k, threshold), "team long, a long, b long, score double")
        return _in_order(edges) if (met or 0) <= TASK_EDGES else DuplicateHandler._by_edges(written(edges, "fuzzy-edges"))

    @staticmethod
    def _by_edges(edges: DataFrame) -> DataFrame:
        """(pos, seed, score) of rows that are gathered."""
        if edges.count() <= TASK_EDGES:
            return _in_order(edges)
        seeds = _seeds(edges)
        # each that is gathered belongs to the first seed it has an edge to
        taken = edges.join(seeds, edges["a"] == seeds["node"]).groupBy("b").agg(F.min(F.struct("a", "score")).alias("s"))
        taken = taken.select(F.col("b").alias("pos"), F.col("s.a").alias("seed"), F.col("s.score").alias("score"))
        return taken.join(seeds.select(F.col("node").alias("pos")), "pos", "left_anti")

    def transform(self, df: DataFrame, survivorship: str = "most_complete") -> DataFrame:
        """One row of each group: ``first``, ``last``, ``most_complete`` or ``merge``; others count as ``first``.

        After ``find_fuzzy`` another frame than the one it was given is searched anew, with the same options.
        Survivors are found by aggregates, which combine before the shuffle: a hot key is no hot task.
        """
        self._survivorship, self._before = survivorship, df
        if self._keys is None and self._fuzzy is None:
            self._method, self._after = "none", df
            return df
        if self._fuzzy is not None:
            if df is not self._found_in:
                self.find_fuzzy(df, **self._asked)
            base = self._ids
            base = base.join(self._fuzzy.select(F.col("row_id").alias("__r"), F.col("group_id").alias("__g")), F.col(ROW) == F.col("__r"), "left")
            order = self._order(base.drop("__r", "__g"))[1] if self.order_by else F.col(ROW)
            keys = [F.coalesce("__g", F.col(ROW)).alias("__k0")]
        else:
            base, order = self._order(df)
            keys = [c.alias(f"__k{i}") for i, c in enumerate(self._key_columns(df))]
        whole = F.struct(*[col(c) for c in df.columns])
        full = sum((F.when(is_missing(f.name, f.dataType), 0).otherwise(1) for f in df.schema.fields), F.lit(0))
        rows = base.select(*keys, order.alias("__o"), full.alias("__full"), whole.alias("__row"))
        grouped = rows.groupBy(*[f"__k{i}" for i in range(len(keys))])
        best = F.min_by("__row", F.struct(-F.col("__full"), F.col("__o")))
        if survivorship == "last":
            out = grouped.agg(F.max_by("__row", "__o").alias("r"))
        elif survivorship == "most_complete":
            out = grouped.agg(best.alias("r"))
        elif survivorship == "merge":
            at = {f.name: F.when(F.col("__row")[f.name].isNotNull() & ~(F.isnan(F.col("__row")[f.name]) if isinstance(f.dataType, FLOATING) else F.lit(False)), F.col("__o")) for f in df.schema.fields}
            first = [F.min_by(F.col("__row")[c], at[c]).alias(f"f{i}") for i, c in enumerate(df.columns)]
            out = grouped.agg(best.alias("b"), *first)
            out = out.select(F.struct(*[_filled(F.col("b")[f.name], F.col(f"f{i}"), f.dataType).alias(f.name) for i, f in enumerate(df.schema.fields)]).alias("r"))
        else:
            out = grouped.agg(F.min_by("__row", "__o").alias("r"))
        self._after = out.select(*[F.col("r")[c].alias(c) for c in df.columns])
        return self._after

    def get_report(self) -> pd.DataFrame:
        columns = list(DuplicateReport.__dataclass_fields__)
        if not self._survivorship:
            return table([], columns)
        before = self._before.count()
        if self._fuzzy is not None:
            found, groups = self._fuzzy.agg(F.count_if(F.col("row_id") != F.col("group_id")), F.count_distinct("group_id")).first()
        elif self._keys is not None:
            per = self._before.groupBy(*self._key_columns(self._before)).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            found, groups = per.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)), F.count(F.lit(1))).first()
        else:
            found, groups = 0, 0
        return table([DuplicateReport(found, groups, before, before - found, found, self._method, self._survivorship).__dict__], columns)


def _filled(best: Column, first: Column, t: T.DataType) -> Column:
    if isinstance(t, FLOATING):
        best = F.nanvl(best, F.lit(None).cast(t))
    return F.coalesce(best, first)
