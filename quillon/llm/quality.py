"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words, all of them, however many. Each passage
is encoded from what its characters and words look like; gated attention
a_k ~ exp(w . (tanh(V h_k) * sigmoid(U h_k))) learns from document labels alone which
passages matter, and the document's score is that of the attention-weighted passage.
Training runs on the driver over a bounded sample of labelled rows; scoring runs over
all documents in the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm import base
from quillon.llm import words as W

#: Words of a passage; labelled documents that a model is fitted on at most.
PASSAGE, SAMPLE = 128, 4000
HIDDEN, GATE, EPOCHS, BATCH, SEED = 32, 16, 30, 128, 5
_EXTRA = 8
WIDTH = 256 + _EXTRA


def features(chunk: W.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(a row of features for each passage, bounds of each text's passages). A text
    without words is one passage of zeros with its own mark."""
    n_words = np.diff(chunk.bounds)
    n_passages = np.maximum(1, -(-n_words // PASSAGE))
    bounds = np.append(0, np.cumsum(n_passages))
    x = np.zeros((bounds[-1], WIDTH), dtype=np.float32)
    if len(chunk.hashes):
        text_of = np.repeat(np.arange(len(n_words)), n_words)
        passage = bounds[text_of] + (np.arange(len(text_of)) - chunk.bounds[text_of]) // PASSAGE
        sizes = chunk.ends - chunk.starts
        raw = np.frombuffer(chunk.data, dtype=np.uint8)
        cum = np.append(0, np.cumsum(~W._SEP[raw]))
        letters = raw[~W._SEP[raw]]
        assert cum[-1] == sizes.sum() == len(letters)
        counts = np.bincount(np.repeat(passage, sizes) * 256 + letters, minlength=len(x) * 256).reshape(-1, 256)
        total = np.maximum(counts.sum(axis=1), 1)
        x[:, :256] = np.sqrt(counts / total[:, None])
        words = np.bincount(passage, minlength=len(x))
        per = np.maximum(words, 1)

        def share(flag: np.ndarray) -> np.ndarray:
            return np.bincount(passage, weights=flag, minlength=len(x)) / per

        def repeated(key: np.ndarray) -> np.ndarray:
            order = np.argsort(key, kind="stable")
            again = np.zeros(len(key), dtype=bool)
            again[order[1:]] = key[order[1:]] == key[order[:-1]]
            return again

        first, last = raw[chunk.starts], raw[chunk.ends - 1]
        upper = (raw >= 65) & (raw <= 90)
        uppers = np.append(0, np.cumsum(upper))
        own = W.mix(chunk.hashes + passage.astype(np.uint64) * W._STEP[3])
        # words with two more behind them in their text
        at = np.flatnonzero(np.arange(2, len(text_of) + 2) < chunk.bounds[text_of + 1])
        triple = chunk.hashes[at] * W._STEP[0] + chunk.hashes[at + 1] * W._STEP[1] + chunk.hashes[at + 2] * W._STEP[2]
        tripled = np.zeros(len(text_of), dtype=bool)
        tripled[at] = repeated(W.mix(triple + text_of[at].astype(np.uint64) * W._STEP[4]))
        x[:, 256] = np.log1p(words) / 5
        x[:, 257] = share(sizes) / 10
        x[:, 258] = share(repeated(own))
        x[:, 259] = share(tripled)
        x[:, 260] = share(uppers[chunk.ends] - uppers[chunk.starts] == sizes)
        x[:, 261] = share((last < 128) & ~(((last | 32) >= 97) & ((last | 32) <= 122)))
        x[:, 262] = share((first >= 65) & (first <= 90))
    x[bounds[:-1][n_words == 0], 263] = 1
    return x, bounds


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _by_row(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w, each row summed in the same order whatever rows are beside it; BLAS may take
    another kernel for other numbers of rows."""
    return np.einsum("ij,j...->i...", x, w, optimize=False)


@dataclass
class Model:
    """Weights; forward() gives each bag's score and what backward() needs."""

    p: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray

    def forward(self, x: np.ndarray, bounds: np.ndarray, product=np.matmul):
        p = self.p
        h = np.tanh(product(x, p["W"]) + p["b"])
        t, g = np.tanh(product(h, p["V"])), _sigmoid(product(h, p["U"]))
        e = product(t * g, p["w"])
        sizes = np.diff(bounds)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, bounds[:-1]), sizes))
        a = e / np.repeat(np.add.reduceat(e, bounds[:-1]), sizes)
        z = np.add.reduceat(a[:, None] * h, bounds[:-1], axis=0)
        return _sigmoid(product(z, p["c"]) + p["d"]), (h, t, g, a, z)

    def backward(self, x, bounds, y, weight, decay):
        p = self.p
        s, (h, t, g, a, z) = self.forward(x, bounds)
        sizes = np.diff(bounds)
        ds = (s - y) * weight / len(y)
        grad = {"c": z.T @ ds, "d": np.array(ds.sum())}
        dz = np.repeat(ds[:, None] * p["c"][None], sizes, axis=0)
        da = (dz * h).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, bounds[:-1]), sizes))
        grad["w"] = (t * g).T @ de
        dtg = de[:, None] * p["w"][None]
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        grad["V"], grad["U"] = h.T @ dt, h.T @ dg
        dh = (a[:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        grad["W"], grad["b"] = x.T @ dh, dh.sum(axis=0)
        for k in ("W", "V", "U", "w", "c"):
            grad[k] = grad[k] + decay * p[k]
        return grad

    def score(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return self.forward((x - self.mean) / self.scale, bounds, _by_row)[0]


def fit(bags: list[np.ndarray], labels: np.ndarray) -> Model:
    """Adam on the mean log loss of the bags."""
    rng = np.random.default_rng(SEED)
    flat = np.concatenate(bags).astype(np.float64)
    mean, scale = flat.mean(axis=0), flat.std(axis=0) + 0.01
    start = {"W": (WIDTH, HIDDEN), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,)}
    p = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) for k, s in start.items()} | {"b": np.zeros(HIDDEN), "d": np.array(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))}
    model = Model(p, mean, scale)
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    step = 0
    for epoch in range(EPOCHS):
        rate = 3e-3 * (1 - epoch / EPOCHS) + 1e-4
        order = rng.permutation(len(bags))
        for i in range(0, len(order), BATCH):
            pick = order[i : i + BATCH]
            x = (np.concatenate([bags[k] for k in pick]) - mean) / scale
            bounds = np.append(0, np.cumsum([len(bags[k]) for k in pick]))
            grad = model.backward(x, bounds, labels[pick], 1.0, 3e-4)
            step += 1
            for k in p:
                m1[k] = 0.9 * m1[k] + 0.1 * grad[k]
                m2[k] = 0.999 * m2[k] + 0.001 * grad[k] ** 2
                p[k] = p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return model


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, label, text) -> (doc_id, label, features as float32 bytes)."""
    for batch in batches:
        for chunk in W.chunks(range(len(batch)), W.column(batch, "text")):
            x, bounds = features(chunk)
            rows = pa.array(chunk.rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array([x[bounds[i] : bounds[i + 1]].tobytes() for i in range(len(rows))], pa.binary())], names=["doc_id", "label", "bag"])


def held_out(doc_id):
    """Whether a document is kept from training: crc32 of its id as text leaves 0 modulo 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | float:
    """A model of labels(doc_id, quality, ...) over docs(doc_id, text, ...), from at most
    ``sample`` labelled documents that are not held out, taken by a hash of doc_id. Of
    several labels of a document the mean counts, rounded; null labels don't. Without
    documents of both labels it is the only label, or 0.5 without any."""
    base.tune(docs.sparkSession)
    usable = base.lean(labels, "doc_id", "quality").where("quality is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.round(F.avg("quality")).cast("double").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = base.lean(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    rows = sorted(base.mapped(texts, _bags, "doc_id long, label double, bag binary").collect())
    labels_ = np.array([r.label for r in rows])
    if len(set(labels_)) < 2:
        return float(labels_[0]) if len(labels_) else 0.5
    return fit([np.frombuffer(r.bag, dtype=np.float32).reshape(-1, WIDTH) for r in rows], labels_)


def _score(model: Model | float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in W.chunks(range(len(batch)), W.column(batch, "text")):
                if isinstance(model, float):
                    s = np.full(len(chunk.rows), model)
                else:
                    s = model.score(*features(chunk))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(chunk.rows)) for k in range(batch.num_columns)), pa.array(s.astype(np.float64))], names=[*batch.schema.names, "score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """docs(doc_id long, text string, ...) -> its columns, held_out boolean, score double
    (0 to 1, higher: label 1 likelier), predicted int (score >= threshold). Whole texts
    are scored, all their passages; null and empty texts too, as one empty passage. A
    null doc_id counts as held out. Equal texts get equal scores. Columns of docs that
    are named like the new ones are replaced. No rows give no rows.
    """
    base.tune(docs.sparkSession)
    model = train(docs, labels, sample)
    rest = docs.drop("held_out", "score", "predicted")
    kinds = T.StructType([*rest.schema.fields, T.StructField("score", T.DoubleType())])
    scored = base.mapped(rest, _score(model), kinds)
    return scored.select(*(F.col(f"`{c}`") for c in rest.columns), held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
