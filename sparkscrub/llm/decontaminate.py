"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

A mask is a fixed choice of token positions; the hash of the chosen tokens ignores the others, so
a substitution at an ignored position leaves a hit. Hits of training and test hashes (same mask)
are joined and verified: in the alignment of the hit, some window of ``window`` tokens that
contains the seed must agree in ``min_share`` of its positions. With the default window and share no
such window is without a hit, wherever its substitutions are (a test goes through all placements).

Where document and item have fewer than MIN_TOKENS tokens in common places, one of them has to be whole in
the other, without substitutions; under SHORT tokens, which turn up in clean text by chance, both have to
be the same. Those are hashed whole.

Training positions are first tested against tables of slots, whose sizes follow the benchmark within bounds: one of
the tokens that all masks start with, then one of the hashes. So only likely hits leave the scan, each with the few
tokens around it. Test hashes are broadcast while they are few, with the tokens around them or, if these are too
many, alone, to drop what the tables let through in vain; beyond that the join does it. No document is shuffled.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkscrub.llm.exact_dedup import text_digest
from sparkscrub.llm.spans import let
from sparkscrub.llm.staging import drop_rows, stage

#: Fixed masks of weight 5; ``1`` marks the positions that are hashed. Of 10 to 20 tokens of which 0.8 agree, at least
#: one place of one mask has no substitution.
MASKS = ("11111", "111011", "11001011")
#: The table has 2**19 to 2**23 slots: SLOTS_A_HASH for each test hash, within these bounds (64 kB to 1 MB).
SLOTS_A_HASH, MIN_SLOT_BITS, MAX_SLOT_BITS = 32, 19, 23
#: Test hashes that are broadcast at most: with the tokens around them (some 400 bytes each), and alone (8 bytes).
BROADCAST_SEEDS, BROADCAST_HASHES = 50_000, 1_000_000
WINDOW, MIN_SHARE = 20, 0.8
#: Tokens that a window with substitutions has at least, and those that a passage has that counts inside of another text.
MIN_TOKENS, SHORT = 10, 5


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; null or empty text has none."""
    flat = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.filter(F.split(flat, " "), lambda t: t != "")


def _seed(th: Column, i: Column, mask: str, k: int) -> Column:
    return F.xxhash64(F.lit(k), *[th[i + j] for j, bit in enumerate(mask) if bit == "1"])


def _positions(n: Column, span: int) -> Column:
    return F.when(n >= span, F.sequence(F.lit(0), n - span)).otherwise(F.array().cast("array<int>"))


def _whole(th: Column) -> Column:
    """Hash of all of a short list of tokens."""
    return F.xxhash64(F.lit(-1), th)


def _lead(masks: tuple[str, ...]) -> list[int]:
    """Positions that are marked in the part that all masks start with."""
    return [i for i, bit in enumerate(os.path.commonprefix(list(masks))) if bit == "1"]


def _slots(h: Column, bits: int) -> tuple[Column, Column]:
    low = F.lit((1 << bits) - 1)
    return h.bitwiseAND(low).cast("int"), F.shiftrightunsigned(h, bits).bitwiseAND(low).cast("int")


def _slot_table(hashes: DataFrame, n: int, each: int) -> tuple[Column, int]:
    """Literal array of 64-bit words, a bit for each of the ``each`` slots of a hash, and the number of bits of a slot."""
    bits = min(MAX_SLOT_BITS, max(MIN_SLOT_BITS, (n * SLOTS_A_HASH - 1).bit_length()))
    slot = hashes.select(F.explode(F.array(*_slots(F.col("h"), bits)[:each])).alias("s"))
    taken = slot.groupBy(F.shiftright("s", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, s & 63)")).alias("bits"))
    words = [0] * ((1 << bits) // 64)
    for r in taken.collect():  # at most 2**17 rows
        words[r["word"]] = r["bits"]
    return F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>"), bits


def _taken(table: Column, slot: Column) -> Column:
    return F.getbit(table[F.shiftright(slot, 6)], slot.bitwiseAND(F.lit(63))) == 1


def _item_hashes(items: DataFrame, masks: tuple[str, ...], window: int) -> DataFrame:
    """item, isize, h, ipos, and of the item's tokens what a window with the seed can reach: ipart, from position ifrom."""
    start = lambda i: F.greatest(i - window, F.lit(0))

    def seeds(mask: str, k: int) -> DataFrame:
        around = lambda i: F.slice("ith", start(i) + 1, F.lit(2 * window + len(mask)))
        each = F.transform(_positions(F.size("ith"), len(mask)), lambda i: F.struct(i.alias("ipos"), start(i).alias("ifrom"), around(i).alias("ipart"), _seed(F.col("ith"), i, mask, k).alias("h")))
        return items.where(F.size("ith") >= SHORT).select("item", F.size("ith").alias("isize"), F.explode(each).alias("s")).select("item", "isize", "s.*")

    whole = F.struct(F.lit(0).alias("ipos"), F.lit(0).alias("ifrom"), F.col("ith").alias("ipart"), _whole(F.col("ith")).alias("h"))
    out = items.where((F.size("ith") > 0) & (F.size("ith") < SHORT)).select("item", F.size("ith").alias("isize"), whole.alias("s")).select("item", "isize", "s.*")
    for k, mask in enumerate(masks):
        out = out.unionByName(seeds(mask, k))
    return out


def _overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, masks: tuple[str, ...], window: int, min_share: float) -> DataFrame:
    """id, digest (of the row's text), item and ``b``, the best window, of every hit whose best window agrees enough."""
    items = benchmark.select(F.col(item_col).alias("item"), F.transform(tokens(F.col(item_text_col)), lambda t: F.xxhash64(t)).alias("ith"))
    seeds = stage(_item_hashes(items, masks, window), "test-hashes")
    hashes = stage(seeds.select("h").distinct(), "test-keys")
    n_hashes = hashes.count()
    table, bits = _slot_table(hashes, n_hashes, 2)
    lead = _lead(masks)
    start = lambda th, i: F.xxhash64(*[th[i + j] for j in lead])
    if lead:
        starts = items.select(F.explode(F.transform(_positions(F.size("ith"), max(lead) + 1), lambda i: start(F.col("ith"), i))).alias("h")).distinct()
        starts = stage(starts, "test-starts")
        lead_table, lead_bits = _slot_table(starts, starts.count(), 1)
    rows = docs.select(F.col(id_col).alias("id"), text_digest(F.col(text_col)).alias("digest"), F.transform(tokens(F.col(text_col)), lambda t: F.xxhash64(t)).alias("th"))
    near = lambda h, i, span: F.struct(
        h.alias("h"), i.alias("pos"), F.lit(span).alias("span"), F.greatest(i - window, F.lit(0)).alias("from"),
        F.slice("th", F.greatest(i - window, F.lit(0)) + 1, F.lit(2 * window + span)).alias("part"), F.size("th").alias("dsize"),
    )

    def hits(table: Column, places: Column, mask: str, k: int) -> Column:
        slots = lambda h: _slots(h, bits)
        # an array of one, so that the hash is made once
        likely = lambda i: F.exists(F.array(_seed(F.col("th"), i, mask, k)), lambda h: _taken(table, slots(h)[0]) & _taken(table, slots(h)[1]))
        inside = lambda i: (i <= F.size("th") - len(mask)) & likely(i)
        return F.transform(F.filter(places, inside), lambda i: near(_seed(F.col("th"), i, mask, k), i, len(mask)))

    places = _positions(F.size("th"), min(map(len, masks)))
    if lead:
        every_place = places
        places = let(lead_table, lambda t: F.filter(every_place, lambda i: _taken(t, _slots(start(F.col("th"), i), lead_bits)[0])))
    short = F.when((F.size("th") > 0) & (F.size("th") < SHORT), F.array(near(_whole(F.col("th")), F.lit(0), 1)))
    # each table is in the plan once
    every = let(table, lambda t: let(places, lambda found: F.concat(*[hits(t, found, m, k) for k, m in enumerate(masks)])))
    found = rows.select("id", "digest", F.explode(F.coalesce(short, every)).alias("x")).select("id", "digest", "x.*")
    if n_hashes <= BROADCAST_SEEDS and seeds.count() <= BROADCAST_SEEDS:
        seeds = F.broadcast(seeds)
    elif n_hashes <= BROADCAST_HASHES:
        found = found.join(F.broadcast(hashes), "h", "left_semi")
    pairs = found.join(seeds, "h")
    # item position of a document position p is p + ipos - pos
    shift = F.col("ipos") - F.col("pos")
    first = F.greatest(F.col("from"), -shift, F.col("pos") + F.col("span") - window)
    last = F.least(F.col("from") + F.size("part"), F.col("isize") - shift, F.col("pos") + window)
    pairs = pairs.withColumns({"first": first, "last": last, "shift": shift})
    same = F.transform(F.sequence(F.col("first"), F.col("last") - 1), lambda p: F.when(F.col("part")[p - F.col("from")] == F.col("ipart")[p + F.col("shift") - F.col("ifrom")], 1).otherwise(0))
    width = lambda v: F.least(F.lit(window), F.size(v))
    need = lambda v: F.ceil(width(v) * F.lit(min_share))
    total = lambda v: F.aggregate(v, F.lit(0), lambda a, x: a + x)
    windows = lambda v: F.transform(F.sequence(F.lit(0), F.size(v) - width(v)), lambda s: F.struct(
        total(F.slice(v, s + 1, width(v))).alias("matched"), width(v).alias("compared"), (-(F.col("first") + s)).alias("at"),
    ))
    # an array of one, so that ``same`` is made once; few hits agree in enough places to be looked at window by window
    inside = (F.col("last") - F.col("first") == F.col("isize")) | (F.col("last") - F.col("first") == F.col("dsize"))
    alike = F.col("isize") == F.col("dsize")
    enough = lambda v: F.when(F.size(v) >= MIN_TOKENS, total(v) >= need(v)).otherwise((total(v) == F.size(v)) & inside & ((F.size(v) >= SHORT) | alike))
    best = F.transform(F.filter(F.array(same), enough), lambda v: F.array_max(windows(v)))
    good = pairs.select("id", "digest", "item", F.explode(best).alias("b"))
    return good.where(F.col("b.matched") >= F.ceil(F.col("b.compared") * F.lit(min_share)))


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", masks: tuple[str, ...] = MASKS,
    window: int = WINDOW, min_share: float = MIN_SHARE,
) -> DataFrame:
    """One row per (document, benchmark item) that overlap: ids, ``matched`` and ``compared`` of the
    best window, and ``start``, the first token of the document in it.

    A window has ``window`` tokens, or all of a shorter item or document part that the alignment
    covers. Under MIN_TOKENS tokens it has to be the whole item or the whole document, unchanged, and
    under SHORT tokens both. Empty texts and nulls overlap with nothing. Rows with one id (null is one) are
    reported together, and so are repeated rows. Ties take the first window. Empty tables give an empty
    result; further columns, whatever their names, are not read.
    """
    good = _overlaps(docs, benchmark, id_col, text_col, item_col, item_text_col, masks, window, min_share)
    top = good.groupBy("id", "item").agg(F.max("b").alias("m"))
    return top.select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("m.matched").cast("long").alias("matched"), F.col("m.compared").cast("long").alias("compared"), (-F.col("m.at")).cast("long").alias("start"))


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    masks: tuple[str, ...] = MASKS, window: int = WINDOW, min_share: float = MIN_SHARE,
) -> DataFrame:
    """``docs`` without the rows whose text overlaps with any benchmark item; other rows of their ids stay.

    Repeated rows go or stay together; rows with null ids or texts are judged like others; columns stay as they
    are. Empty tables are allowed: without items nothing goes.
    """
    bad = _overlaps(docs, benchmark, id_col, text_col, item_col, item_text_col, masks, window, min_share).select("id", "digest")
    return drop_rows(docs, [F.col(id_col), text_digest(F.col(text_col))], bad)
