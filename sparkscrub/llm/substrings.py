"""Removal of word passages that occur more than once, by suffix automata of reference shards.

1. Anchors. In every window of ``window`` words the k-gram with the smallest hash is its anchor, so
   equal windows have equal anchors. Anchors with one position in the whole corpus are dropped;
   a bitmap of the others (of bounded size) marks the windows that may repeat. This is a filter
   only: surplus windows are sorted out by the automata.
2. Segments are the maximal runs of words that such windows cover. Equal segments are one, with a
   count.
3. Each anchor has an owner, the longest segment that holds it, and each owner a reference shard.
   Segments are cut into pieces: runs of windows whose anchors belong to one shard. So every window,
   wherever it occurs, comes to the shard of its anchor and to no other, and neighbouring windows
   mostly stay together. Equal pieces are one, with a count.
4. A shard's pieces are its reference text. A suffix automaton with occurrence counts is built from
   them, and the pieces are streamed through it: matching statistics, cut at ``window`` words, tell how
   often each of their windows occurs. Two occurrences or more are a repeat.
5. The words of such windows are removed from the documents.

A family of segments with one owner is spread over shards by anchor when it is large. A shard that is
still over its bound (one anchor in very many contexts) is cut again, by the hash of whole windows, into
as many shards as its windows need; long runs are cut at RUN windows. So no automaton, and no group of
rows, is made of much more than BLOCK_WORDS words, whatever the data.

An automaton of all reference text cannot be broadcast: it grows with the corpus. Windows are sent to the
automaton of their anchor's shard instead, which gives the same matching statistics from window on up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkscrub.llm.staging import BLOCK_BITS, small_batches, stage
from sparkscrub.llm.words import U64, hash_words, mix, runs_of, starts_of

GRAM = 16
#: Words that a reference shard should have, the words that one automaton may have at most (about), and windows of one piece.
SHARD_WORDS, BLOCK_WORDS, RUN = 60_000, 160_000, 4096
#: The bitmap has 64 bits for each repeated anchor, within these bounds (at most 128 MB).
MIN_BITS, MAX_BITS = 1 << 20, 1 << 30


def _sliding(a: np.ndarray, w: int, pick) -> np.ndarray:
    """Minimum or maximum of every ``w`` consecutive elements, by doubling."""
    have, out = 1, a
    while have < w:
        step = min(have, w - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out


def window_anchors(words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each window, and the k-grams that are the anchor of some window (per position)."""
    grams = runs_of(words, gram)
    w = window - gram + 1
    if len(grams) < w:
        return grams[:0], grams[:0]
    least = _sliding(grams, w, np.minimum)
    pad = np.zeros(w - 1, U64)
    reach = _sliding(np.concatenate([pad, least, pad]), w, np.maximum)
    return least, grams[reach == grams]


def _docs(batch: pa.RecordBatch, column: int) -> tuple[list[bytes], list[np.ndarray]]:
    texts = [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]
    (hashes,), owner = hash_words(texts)
    at = starts_of(owner, len(texts))
    return texts, [hashes[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _anchor_counts(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, docs = _docs(batch, 0)
            found = [window_anchors(d, window, gram)[1] for d in docs if len(d) >= window]
            values, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, U64), np.zeros(0, int))
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64), pa.int64()), pa.array(counts, pa.int64())], ["anchor", "n"])

    return run


def _bit_slots(values: np.ndarray, bits: int) -> list[np.ndarray]:
    mask = U64(bits - 1)
    return [(mix(values + U64(k)) & mask).astype(np.int64) for k in range(3)]


def _bitmap_rows(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = np.unique(np.concatenate(_bit_slots(batch.column(0).to_numpy().view(U64), bits)))
            yield pa.RecordBatch.from_arrays([pa.array(slots // BLOCK_BITS), pa.array(slots % BLOCK_BITS)], ["block", "pos"])

    return run


def _bitmap(anchors: DataFrame) -> tuple[np.ndarray, int]:
    """Bits of the repeated anchors; its size is bounded by MAX_BITS."""
    n = anchors.count()
    bits = MIN_BITS
    while bits < 64 * n and bits < MAX_BITS:
        bits *= 2
    rows = anchors.mapInArrow(_bitmap_rows(bits), "block long, pos long").groupBy("block").agg(F.bitmap_construct_agg("pos").alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in rows.toLocalIterator():
        out[r["block"] * 4096 : (r["block"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out, bits


def _joined_sha(text: bytes, keep: np.ndarray | None = None) -> str:
    words = text.split()
    if keep is not None:
        words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
    return hashlib.sha256(b" ".join(words)).hexdigest()


SEGMENT_SCHEMA = "id long, n_words long, kept_sha256 string, text binary, segs array<binary>, starts array<int>, sizes array<int>"


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _runs(at: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of sorted positions that are at most ``gap`` apart."""
    cut = np.flatnonzero(np.diff(at) > gap)
    return at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]


def _segments(window: int, gram: int, bitmap, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bitmap.value
        for batch in batches:
            texts, docs = _docs(batch, 1)
            cols: list[list] = [[] for _ in range(7)]
            for doc_id, text, words in zip(batch.column(0).to_pylist(), texts, docs, strict=True):
                least = window_anchors(words, window, gram)[0]
                hit = np.ones(len(least), bool)
                for slot in _bit_slots(least, bits):
                    hit &= (table[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0
                row = [doc_id, len(words), None, None, None, None, None]
                if hit.any():
                    first, last = _runs(np.flatnonzero(hit), window)
                    last, split = last + window, text.split()
                    row[3:] = [text, [_digest(split[a:b]) for a, b in zip(first, last, strict=True)], first.tolist(), (last - first).tolist()]
                else:
                    row[2] = _joined_sha(text)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            types = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["id", "n_words", "kept_sha256", "text", "segs", "starts", "sizes"])

    return run


def _segment_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, segs, starts, sizes) -> a row (seg, size, text) for each segment, once in a batch."""
    for batch in batches:
        found: dict[bytes, list] = {}
        for text, segs, starts, sizes in zip(batch.column(0).cast(pa.binary()).to_pylist(), *(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            words = text.split()
            for seg, a, n in zip(segs, starts, sizes, strict=True):
                if seg in found:
                    found[seg][2] += 1
                else:
                    found[seg] = [n, b" ".join(words[a : a + n]), 1]
        rows = [(seg, n, text, times) for seg, (n, text, times) in found.items()]
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.binary(), pa.int64()), strict=True)], ["seg", "size", "text", "times"])


def _segment_anchors(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, docs = _docs(batch, 1)
            found = [np.unique(window_anchors(d, window, gram)[0], return_counts=True) for d in docs]
            index = np.repeat(np.arange(len(docs)), [len(f[0]) for f in found])
            anchors = np.concatenate([f[0] for f in found]).view(np.int64) if found else np.zeros(0, np.int64)
            words = np.concatenate([f[1] for f in found]) + window - 1 if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index)), batch.column(2).take(pa.array(index)), pa.array(anchors, pa.int64()), pa.array(words, pa.int64())], ["seg", "size", "anchor", "words"])

    return run


PIECE_SCHEMA = "shard long, piece binary, size long, times long, seg binary, at array<int>, text binary"


def _cut(of: np.ndarray, words: list[bytes], window: int, times: int, seg: bytes, at: list[int], run: int) -> list[tuple]:
    """Different pieces of a sequence of words, each with its places: runs of windows of one shard, of at most ``run`` windows.

    The sequence occurs ``times`` times, each time at all of ``at``.
    """
    edges = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1, [len(of)]])
    starts = np.unique(np.concatenate([np.arange(a, b, run) for a, b in zip(edges[:-1], edges[1:], strict=True)]))
    found: dict[tuple[int, bytes], list] = {}
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(of)], strict=True):
        part = words[a : b + window - 1]
        found.setdefault((int(of[a]), _digest(part)), [part, []])[1].append(a)
    return [(shard, piece, len(part), times * len(at) * len(places), seg, [x + y for x in at for y in places], b" ".join(part)) for (shard, piece), (part, places) in found.items()]


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 7
    types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["shard", "piece", "size", "times", "seg", "at", "text"])


def _pieces(window: int, gram: int, most: int):
    """(seg, text, times, anchors, shards) -> pieces of the segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, docs = _docs(batch, 1)
            rows: list[tuple] = []
            for seg, text, words, times, anchors, shards in zip(batch.column(0).to_pylist(), texts, docs, *(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                anchors, shards = np.array(anchors, np.int64).view(U64), np.array(shards, np.int64)
                order = np.argsort(anchors)
                of = shards[order][np.searchsorted(anchors[order], window_anchors(words, window, gram)[0])]
                rows += _cut(of, text.split(), window, times, seg, [0], most)
            yield _piece_batch(rows)

    return run


def _recut(window: int, most: int):
    """(shard, parts, seg, at, times, text) of pieces of crowded shards -> pieces by hashes of whole windows.

    Equal windows of a shard come to one of its ``parts`` parts, which get numbers of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, docs = _docs(batch, 5)
            rows: list[tuple] = []
            for shard, parts, seg, at, times, text, words in zip(*(batch.column(i).to_pylist() for i in range(5)), texts, docs, strict=True):
                of = mix(runs_of(words, window) % U64(parts) + U64(shard + 1) * U64(0x9E3779B97F4A7C15)).view(np.int64)
                rows += _cut(of, text.split(), window, times // len(at), seg, at, most)
            yield _piece_batch(rows)

    return run


class SuffixAutomaton:
    """Suffix automaton of word sequences with occurrence counts."""

    def __init__(self) -> None:
        self.next: list[dict[bytes | int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]
        self.ends = 0

    def add(self, words: list[bytes], times: int) -> None:
        """Add a sequence that occurs ``times`` times; no match runs on into another sequence."""
        nxt, link, length, count = self.next, self.link, self.length, self.count
        last = 0
        if len(nxt) > 1:
            self.ends -= 1
            last = self._extend(self._end, self.ends, 0)
        for w in words:
            # one more state, as in the usual construction
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            count.append(times)
            link.append(0)
            p = last
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][w]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    twin = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    count.append(0)
                    link[q] = link[cur] = twin
                    while p >= 0 and nxt[p].get(w) == q:
                        nxt[p][w] = twin
                        p = link[p]
            last = cur
        self._end = last

    def _extend(self, last: int, w: int, times: int) -> int:
        """A separator: a symbol that occurs once, so its state links to the root."""
        cur = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.count.append(times)
        self.link.append(0)
        p = last
        while p >= 0:
            self.next[p][w] = cur
            p = self.link[p]
        return cur

    def finish(self) -> None:
        """Sum occurrences over suffix links, longest states first."""
        order = np.argsort(-np.array(self.length), kind="stable").tolist()
        for v in order:
            if self.link[v] >= 0:
                self.count[self.link[v]] += self.count[v]

    def occurrences(self, words: list[bytes], window: int) -> list[int]:
        """For each window of ``words``, how often it occurs in the sequences."""
        nxt, link, length, count = self.next, self.link, self.length, self.count
        v, n, out = 0, 0, []
        for w in words:
            while v and w not in nxt[v]:
                v = link[v]
                n = length[v]
            if w in nxt[v]:
                v = nxt[v][w]
                n += 1
            while v and length[link[v]] >= window:
                v = link[v]
                n = length[v]
            out.append(count[v] if n >= window else 0)
        return out[window - 1 :]


def _match(window: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        automaton = SuffixAutomaton()
        texts = [t.split() for t in group["text"]]
        for words, times in zip(texts, group["times"], strict=True):
            automaton.add(words, int(times))
        automaton.finish()
        pieces, spans = [], []
        for piece, words, times in zip(group["piece"], texts, group["times"], strict=True):
            if times == 1:
                at = np.flatnonzero(np.array(automaton.occurrences(words, window)) >= 2)
                if len(at):
                    first, last = _runs(at, 1)
                    pieces.append(piece)
                    spans.append(np.stack([first, last + window], 1).reshape(-1).astype(np.int32).tobytes())
        shard = group["shard"].iloc[0]
        return pd.DataFrame({"shard": pd.Series([shard] * len(pieces), dtype="int64"), "piece": pd.Series(pieces, dtype=object), "spans": pd.Series(spans, dtype=object)})

    return run


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, counts, shas, removed = batch.column(0), batch.column(1), [], []
        for text, n, parts in zip(batch.column(2).cast(pa.binary()).to_pylist(), counts.to_pylist(), batch.column(3).to_pylist(), strict=True):
            keep = np.ones(n, bool)
            for part in parts or []:
                for found in part["found"]:
                    spans = np.array([0, found["size"]]) if found["spans"] is None else np.frombuffer(found["spans"], np.int32)
                    for at in found["at"]:
                        start = part["start"] + at
                        for a, b in spans.reshape(-1, 2):
                            keep[start + a : start + b] = False
            shas.append(_joined_sha(text, keep))
            removed.append(int(n - keep.sum()))
        yield pa.RecordBatch.from_arrays([ids, counts, pa.array(removed, pa.int64()), pa.array(shas, pa.string())], ["id", "n_words", "n_removed", "kept_sha256"])


def repeated_passages(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", gram: int | None = None, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS, run: int = RUN) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, kept_sha256 (of the words left, joined by spaces).

    A word is removed if a window of ``window`` words that covers it also starts anywhere else, in
    any row, the same one included; windows are judged on the input. Null and empty texts have no
    words. Repeated rows repeat each other. Texts shorter than a window are left alone. Texts are
    bytes: those that are no valid UTF-8 are handled like others. Columns other than id and text are
    not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    gram = gram or min(GRAM, max(1, window // 2))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    counts = texts.select("text").mapInArrow(_anchor_counts(window, gram), "anchor long, n long")
    anchors = stage(counts.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"), "passage-anchors")
    table, bits = _bitmap(anchors)
    shared = spark.sparkContext.broadcast(table)
    rows = texts.mapInArrow(_segments(window, gram, shared, bits), SEGMENT_SCHEMA).withColumn("row", F.monotonically_increasing_id())
    rows = stage(rows, "passage-rows")
    live = rows.where("segs is not null")

    each = live.select("text", "segs", "starts", "sizes").mapInArrow(_segment_texts, "seg binary, size long, text binary, times long")
    segs = each.groupBy("seg").agg(F.first("size").alias("size"), F.first("text").alias("text"), F.sum("times").alias("times"))
    segs = stage(segs, "passage-segments")

    by_anchor = stage(segs.select("seg", "text", "size").mapInArrow(_segment_anchors(window, gram), "seg binary, size long, anchor long, words long"), "passage-by-anchor")
    longest = F.shiftleft(F.lit(1 << 22) - F.least("size", F.lit((1 << 22) - 1)), 40) + F.pmod(F.xxhash64("seg"), F.lit(1 << 40))
    owners = by_anchor.groupBy("anchor").agg(F.min(longest).alias("owner"), F.sum("words").alias("n"))
    owners = stage(owners, "passage-owners")
    words = F.sum("n")
    shards = max(1, -(-(owners.agg(words).first()[0] or 0) // shard_words))
    parts = owners.groupBy("owner").agg(F.ceil(words / shard_words).cast("long").alias("parts"))
    homes = owners.join(parts, "owner").select("anchor", F.pmod(F.xxhash64("owner", F.pmod(F.xxhash64("anchor"), "parts")), F.lit(shards)).alias("shard"))
    routes = by_anchor.join(homes, "anchor").groupBy("seg").agg(F.collect_list("anchor").alias("anchors"), F.collect_list("shard").alias("shards"))
    raw = segs.select("seg", "text", "times").join(routes, "seg").select("seg", "text", "times", "anchors", "shards")
    raw = stage(raw.mapInArrow(_pieces(window, gram, run), PIECE_SCHEMA), "passage-pieces")
    per = raw.groupBy("shard", "piece").agg(F.first("size").alias("size")).groupBy("shard").agg(F.sum("size").alias("words"))
    # each window stands alone at worst
    parts = F.ceil(F.col("words") * window / block_words).cast("long")
    crowded = stage(per.where(F.col("words") > block_words).select(F.col("shard").alias("crowd"), parts.alias("parts")), "passage-crowded")
    again = raw.join(crowded, raw["shard"] == crowded["crowd"]).select("shard", "parts", "seg", "at", "times", "text").mapInArrow(_recut(window, run), PIECE_SCHEMA)
    raw = stage(raw.join(crowded, raw["shard"] == crowded["crowd"], "left_anti").unionByName(again), "passage-pieces")

    work = raw.groupBy("shard", "piece").agg(F.first("text").alias("text"), F.sum("times").alias("times"))
    found = work.select("shard", "piece", "text", "times").groupBy("shard").applyInPandas(_match(window), "shard long, piece binary, spans binary")
    whole = raw.groupBy("shard", "piece").agg(F.sum("times").alias("times")).where("times > 1").select("shard", "piece", F.lit(None).cast("binary").alias("spans"))
    found = stage(found.unionByName(whole), "passage-spans")
    by_seg = raw.select("shard", "piece", "seg", "at", "size").join(found, ["shard", "piece"]).groupBy("seg").agg(F.collect_list(F.struct("at", "size", "spans")).alias("found"))

    parts = live.select("row", F.explode(F.arrays_zip("segs", "starts")).alias("s")).select("row", F.col("s.segs").alias("seg"), F.col("s.starts").alias("start"))
    parts = parts.join(by_seg, "seg").groupBy("row").agg(F.collect_list(F.struct("start", "found")).alias("parts"))
    open_rows = live.select("row", "id", "n_words", "text").join(parts, "row", "left")
    done = open_rows.select("id", "n_words", "text", "parts").mapInArrow(_finish, "id long, n_words long, n_removed long, kept_sha256 string")
    closed = rows.where("segs is null").select("id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256")
    return closed.unionByName(done).withColumnRenamed("id", id_col)
