"""Toxicity by non-negative positive-unlabelled learning, in numpy.

Confirmed toxic texts are the positives; a sample of the corpus, whose labels are not read, is the
unlabelled set. With class prior p, the risk of calling unlabelled text toxic is corrected by what
its share p of toxic texts contributes: R = p R_P(+) + max(0, R_U(-) - p R_P(-)). Where the corrected
part is negative, the model over-fits the positives, and the step goes the other way.

A text is the set of its words and of their first bytes (4, 5 and 6), hashed into BUCKETS; words are
runs of letters, A-Z lower-cased. The model is linear in that set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkscrub.llm.labelled import SAMPLE_BYTES, held_out, sample_texts
from sparkscrub.llm.staging import small_batches
from sparkscrub.llm.words import U64, hash_words

BUCKETS = 1 << 20
PREFIXES = (4, 5, 6)
#: Rows used for fitting, at most.
SAMPLE_POSITIVE, SAMPLE_UNLABELLED = 2000, 8000
#: A bucket is used if its count among positives is LIFT times what the unlabelled set leads to expect, and so many deviations above.
LIFT, DEVIATIONS = 3.0, 4.0

_NOT_LETTER = np.ones(256, bool)
_NOT_LETTER[65:91] = _NOT_LETTER[97:123] = _NOT_LETTER[128:] = False


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs as two arrays, in order."""
    hashes, owner = hash_words(texts, lower=True, sep=_NOT_LETTER, prefixes=PREFIXES)
    buckets = np.concatenate([(h & U64(BUCKETS - 1)).astype(np.int64) for h in hashes])
    both = np.unique(np.tile(owner, len(hashes)) * BUCKETS + buckets)
    return both // BUCKETS, both % BUCKETS


def _in_parts(texts: list[bytes], rows: int = 200) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Features of some texts at a time, which bounds memory: (index of the first, owner, bucket)."""
    for a in range(0, len(texts), rows):
        yield a, *features(texts[a : a + rows])


def _counts(texts: list[bytes]) -> np.ndarray:
    """In how many texts each bucket is."""
    out = np.zeros(BUCKETS, np.int64)
    for _, _, bucket in _in_parts(texts):
        out += np.bincount(bucket, minlength=BUCKETS)
    return out


def _chosen(texts: list[bytes], slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of the features that have a slot."""
    owners, slots = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, owner, bucket in _in_parts(texts):
        s = slot[bucket]
        owners.append(owner[s >= 0] + a)
        slots.append(s[s >= 0])
    return np.concatenate(owners), np.concatenate(slots)


class PuModel:
    """Weights of the buckets and a bias."""

    def __init__(self) -> None:
        self.weights, self.bias = np.zeros(BUCKETS, np.float32), 0.0

    def fit(self, positive: list[bytes], unlabelled: list[bytes], prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-3) -> PuModel:
        if not positive or not unlabelled:
            self.bias = -4.0
            return self
        prior = float(np.clip(prior, 1e-3, 0.9))
        np_, nu = len(positive), len(unlabelled)
        pc, uc = _counts(positive), _counts(unlabelled)
        # only what is surely commoner among positives can speak for them
        expected = np_ * (uc + 0.5) / nu
        chosen = np.flatnonzero((pc >= 3) & (pc > LIFT * expected) & (pc - expected > DEVIATIONS * np.sqrt(expected)))
        slot = np.full(BUCKETS, -1)
        slot[chosen] = np.arange(len(chosen))
        (po, pb), (uo, ub) = _chosen(positive, slot), _chosen(unlabelled, slot)
        w, b = np.zeros(len(chosen)), -2.0
        m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
        sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        for t in range(1, steps + 1):
            fp = np.bincount(po, w[pb], np_) + b
            fu = np.bincount(uo, w[ub], nu) + b
            low = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
            sp, su = sigmoid(fp), sigmoid(fu)
            gp_pos, gp_neg, gu = -prior * (1 - sp) / np_, -prior * sp / np_, su / nu
            if low >= 0:
                gp, gu = gp_pos + gp_neg, gu
            else:
                gp, gu = -gp_neg, -gu
            gw = np.bincount(pb, gp[po], len(w)) + np.bincount(ub, gu[uo], len(w)) + decay * w
            g = np.append(gw, gp.sum() + gu.sum())
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            move = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w, b = w - move[:-1], b - move[-1]
        self.weights[chosen], self.bias = w, float(b)
        return self

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probability that each text is toxic."""
        owner, bucket = features(texts)
        z = np.bincount(owner, self.weights[bucket], len(texts)) + self.bias if len(texts) else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", mod: int = 5, rest: int = 0,
    prior: float | None = None, positives: int = SAMPLE_POSITIVE, unlabelled: int = SAMPLE_UNLABELLED, sample_bytes: int = SAMPLE_BYTES,
) -> PuModel:
    """Fit on at most ``positives`` and ``unlabelled`` rows, and ``sample_bytes`` bytes of each text.

    ``prior``: the share of toxic texts, by default that of the labelled rows not held out. Null ids and labels are
    not used; of repeated ids one row is; null texts count as empty. Without toxic rows, or without documents, every
    text gets the same low score.
    """
    usable = labels.where(~held_out(F.col(id_col), mod, rest))
    if prior is None:
        prior = usable.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.01
    toxic = sample_texts(docs, usable.where(F.col(label) == 1).select(id_col), positives, id_col, text_col, [], sample_bytes)
    some = sample_texts(docs, docs.select(id_col), unlabelled, id_col, text_col, [], sample_bytes)
    return PuModel().fit([bytes(t) for t in toxic["text"]], [bytes(t) for t in some["text"]], prior)


def score_toxicity(docs: DataFrame, model: PuModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``score`` of every row; null counts as empty, whose score is the bias alone.

    Repeated rows get a score each, null ids too; other columns are not read. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # 4 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = PuModel()
        own.weights, own.bias = shared.value
        for b in batches:
            scores = own.score([t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], ["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, score double").withColumnRenamed("id", id_col)
