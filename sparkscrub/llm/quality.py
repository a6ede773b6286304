"""Quality classifier: a byte-level convolutional network in numpy.

Layer 1, over bytes: FILTERS learned filters, each WIDTH bytes wide, with a ReLU; and fixed shift
filters, which fire where a byte equals the one LAG places before (repeated words do that over long
stretches). Both are averaged over chunks of two blocks; chunks overlap by one block and cover the
whole text. Layer 2: HIDDEN learned filters over a chunk's averages, with a ReLU, max-pooled over all
chunks of the text. Layer 3: a logistic unit combines them into one probability.

Fitting uses a bounded sample of labelled rows and back-propagation on the driver; scoring runs in
Arrow batches on the executors and reads every byte of every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkscrub.llm.labelled import SAMPLE_BYTES, held_out, sample_texts
from sparkscrub.llm.staging import small_batches

BLOCK, FILTERS, WIDTH, HIDDEN = 256, 8, 4, 16
LAGS = tuple(range(2, 26))
PAD = 256
#: Rows of each label used for fitting, at most.
SAMPLE_PER_LABEL = 800
#: Blocks scored at a time.
GROUP_BLOCKS = 512


def blocks_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of shape (blocks, BLOCK), texts padded to whole blocks and parted by one empty block; owner of each block or -1."""
    counts = [max(1, -(-len(t) // BLOCK)) for t in texts]
    codes = np.full((sum(counts) + len(texts) + 1) * BLOCK, PAD, np.int16)
    owner = np.full(sum(counts) + len(texts) + 1, -1)
    at = 1
    for i, (t, n) in enumerate(zip(texts, counts, strict=True)):
        codes[at * BLOCK : at * BLOCK + len(t)] = np.frombuffer(t, np.uint8)
        owner[at : at + n] = i
        at += n + 1
    return codes, owner


class ByteNet:
    """The network; ``params`` are arrays of fixed size, whatever the corpus."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        n = FILTERS + len(LAGS)
        self.params = {
            "t": rng.normal(0, 0.3, (WIDTH, PAD + 1, FILTERS)).astype(np.float32), "b": np.zeros(FILTERS, np.float32),
            "c": rng.normal(0, 1 / np.sqrt(n), (n, HIDDEN)).astype(np.float32), "d": np.full(HIDDEN, 0.1, np.float32),
            "w": rng.normal(0, 0.3, HIDDEN).astype(np.float32), "o": np.zeros(1, np.float32),
        }
        self.params["t"][:, PAD] = 0

    def _layer1(self, codes: np.ndarray) -> np.ndarray:
        t = self.params["t"]
        ext = np.concatenate([codes, np.full(WIDTH - 1, PAD, np.int16)])
        z = t[0][ext[: len(codes)]] + self.params["b"]
        for j in range(1, WIDTH):
            z += t[j][ext[j : j + len(codes)]]
        z[ext[WIDTH - 1 :] == PAD] = 0  # filters that reach beyond the text are silent
        return np.maximum(z, 0, out=z)

    @staticmethod
    def _shifts(codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes) // BLOCK, len(LAGS)), np.float32)
        real = codes != PAD
        for k, lag in enumerate(LAGS):
            same = np.zeros(len(codes), bool)
            np.equal(codes[lag:], codes[:-lag], out=same[lag:])
            same &= real
            out[:, k] = same.reshape(-1, BLOCK).sum(1, dtype=np.uint16)
        return out

    def _chunks(self, codes: np.ndarray, owner: np.ndarray, layer1: np.ndarray, shifts: np.ndarray):
        """Averages over chunks; for each chunk its text, its first block and whether it has a second."""
        sums = np.concatenate([layer1.reshape(-1, BLOCK, FILTERS).sum(1), shifts], 1)
        size = (codes.reshape(-1, BLOCK) != PAD).sum(1)
        same = np.zeros(len(owner), bool)
        same[:-1] = (owner[:-1] == owner[1:]) & (owner[:-1] >= 0)
        before = np.concatenate([[False], same[:-1]])
        first = np.flatnonzero(same | ((owner >= 0) & ~before))
        two = same[first]
        total = sums[first] + np.where(two[:, None], sums[np.minimum(first + 1, len(sums) - 1)], 0)
        n = np.maximum(1, size[first] + np.where(two, size[np.minimum(first + 1, len(size) - 1)], 0)).astype(np.float32)
        return total / n[:, None], n, owner[first], first, two

    def _top_of_long(self, text: bytes) -> np.ndarray:
        """Max-pooled layer 2 of one long text, walked in groups of blocks that overlap by one, so that memory stays bounded.

        Each group has a block more on either side, which its filters look into.
        """
        n, top = -(-len(text) // BLOCK), np.zeros(HIDDEN, np.float32)
        for a in range(0, n - 1, GROUP_BLOCKS - 1):
            b = min(n, a + GROUP_BLOCKS)
            codes = np.full((b - a + 2) * BLOCK, PAD, np.int16)
            lo, hi = max(0, a - 1) * BLOCK, min(len(text), (b + 1) * BLOCK)
            put = (max(0, a - 1) - a + 1) * BLOCK
            codes[put : put + hi - lo] = np.frombuffer(text, np.uint8, hi - lo, lo)
            owner = np.zeros(b - a + 2, int)
            owner[[0, -1]] = -1
            x = self._chunks(codes, owner, self._layer1(codes), self._shifts(codes))[0]
            np.maximum(top, np.maximum(x @ self.params["c"] + self.params["d"], 0).max(0), out=top)
        return top

    def forward(self, texts: list[bytes]):
        codes, owner = blocks_of(texts)
        layer1 = self._layer1(codes)
        x, n, of, first, two = self._chunks(codes, owner, layer1, self._shifts(codes))
        h = np.maximum(x @ self.params["c"] + self.params["d"], 0)
        at = np.searchsorted(of, np.arange(len(texts)))
        top = np.maximum.reduceat(h, at, axis=0)
        logit = top @ self.params["w"] + self.params["o"][0]
        return logit, (codes, layer1, x, n, of, first, two, h, top)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probability of label 1 of each text, in groups of bounded size."""
        out, group, held = [], [], 0

        def flush() -> None:
            nonlocal group, held
            if group:
                out.append(self.forward(group)[0])
            group, held = [], 0

        for t in texts:
            if len(t) > GROUP_BLOCKS * BLOCK:
                flush()
                out.append((self._top_of_long(t) @ self.params["w"] + self.params["o"][0])[None])
                continue
            group.append(t)
            held += len(t) // BLOCK + 2
            if held >= GROUP_BLOCKS:
                flush()
        flush()
        z = np.concatenate(out).astype(np.float64) if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def gradients(self, texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean weighted loss, summed over groups of texts of bounded size."""
        total, out, start, held = weight.sum(), {}, 0, 0
        for i, t in enumerate(texts):
            held += len(t) // BLOCK + 2
            if held >= GROUP_BLOCKS or i + 1 == len(texts):
                part = slice(start, i + 1)
                for k, g in self._gradients(texts[part], y[part], weight[part] / total).items():
                    out[k] = out[k] + g if k in out else g
                start, held = i + 1, 0
        return out

    def _gradients(self, texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        logit, (codes, layer1, x, n, of, first, two, h, top) = self.forward(texts)
        p = self.params
        g = ((1 / (1 + np.exp(-logit)) - y) * weight).astype(np.float32)
        out = {"w": top.T @ g, "o": np.array([g.sum()], np.float32)}
        dtop = g[:, None] * p["w"]
        best = (h == top[of]) & (h > 0)
        ties = np.add.reduceat(best, np.searchsorted(of, np.arange(len(texts))), axis=0)
        dh = np.where(best, dtop[of] / np.maximum(1, ties)[of], 0).astype(np.float32)
        out |= {"c": x.T @ dh, "d": dh.sum(0)}
        dx = (dh @ p["c"].T)[:, :FILTERS] / n[:, None]
        dblock = np.zeros((len(codes) // BLOCK, FILTERS), np.float32)
        np.add.at(dblock, first, dx)
        np.add.at(dblock, first[two] + 1, dx[two])
        used = np.flatnonzero(np.abs(dblock).sum(1))
        dz = np.where(layer1.reshape(-1, BLOCK, FILTERS)[used] > 0, dblock[used][:, None], 0).reshape(-1, FILTERS)
        ext = np.concatenate([codes, np.full(WIDTH - 1, PAD, np.int16)])
        pos = (used[:, None] * BLOCK + np.arange(BLOCK)).reshape(-1)
        out["b"] = dz.sum(0)
        dt = np.zeros_like(p["t"])
        for j in range(WIDTH):
            code = ext[pos + j]
            for f in range(FILTERS):
                dt[j, :, f] = np.bincount(code, dz[:, f], PAD + 1)
        dt[:, PAD] = 0
        return out | {"t": dt}

    def fit(self, texts: list[bytes], y: np.ndarray, epochs: int = 10, batch: int = 32, rate: float = 0.02, seed: int = 1) -> ByteNet:
        """Adam on the logistic loss, both labels weighing the same in all."""
        if not len(y):
            return self
        rng, y = np.random.default_rng(seed), np.asarray(y, np.float32)
        share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        m, v, step = {k: np.zeros_like(a) for k, a in self.params.items()}, {k: np.zeros_like(a) for k, a in self.params.items()}, 0
        epochs = max(epochs, min(40, -(-epochs * 400 // len(y))))  # small samples are passed more often
        total = epochs * -(-len(y) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for a in range(0, len(order), batch):
                take, step = order[a : a + batch], step + 1
                lr = rate * (1 - 0.9 * step / total)
                for k, g in self.gradients([texts[i] for i in take], y[take], weight[take]).items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.01 * (g * g - v[k])
                    self.params[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return self


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", mod: int = 3, rest: int = 1, sample: int = SAMPLE_PER_LABEL, sample_bytes: int = SAMPLE_BYTES) -> ByteNet:
    """Fit on at most ``sample`` rows of each label, none of them held out, and ``sample_bytes`` bytes of each text.

    Labels without a text, texts without a label, null ids and null labels are not used; of repeated ids one row is.
    Null texts count as empty. Without labels, or without documents, the net is untrained.
    """
    usable = labels.where(~held_out(F.col(id_col), mod, rest)).select(id_col, F.col(label).alias("y"))
    parts = [sample_texts(docs, usable.where(F.col("y") == v), sample, id_col, text_col, ["y"], sample_bytes) for v in (0, 1)]
    texts = [t if isinstance(t, bytes) else bytes(t) for p in parts for t in p["text"]]
    return ByteNet().fit(texts, np.concatenate([p["y"].to_numpy(float) for p in parts]))


def score_quality(docs: DataFrame, net: ByteNet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``score`` of every row; null counts as empty, and an empty text has a score too.

    Repeated rows get a score each, null ids too; other columns are not read. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(net.params)  # some 40 kB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ByteNet()
        own.params = model.value
        for b in batches:
            scores = own.score([t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], ["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, score double").withColumnRenamed("id", id_col)


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the classifier scores under ``threshold``, in one pass and with no shuffle.

    Equal texts, null (as empty) and repeated ones included, are kept or dropped alike; ids may be null or repeated;
    all columns stay as they are. An empty table gives an empty result; without labels the net is untrained.
    """
    net = fit_quality(docs, labels, id_col=id_col, text_col=text_col)
    small_batches(docs.sparkSession)
    model, at = docs.sparkSession.sparkContext.broadcast(net.params), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ByteNet()
        own.params = model.value
        for b in batches:
            yield b.filter(pa.array(own.score([t or b"" for t in b.column(at).cast(pa.binary()).to_pylist()]) >= threshold))

    return docs.mapInArrow(run, docs.schema)
