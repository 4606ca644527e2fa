"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes. Each passage is encoded by how often each class of
character follows each other one, and by how often a word repeats one of the few before it; a dense layer
makes an embedding of that. Gated attention, a = softmax(w . (tanh(V h) * sigmoid(U h))), weighs the
embeddings of a document's passages, and a logistic layer scores their weighted mean. All layers are
learned together from document labels alone, by Adam on exact gradients.

Fitted on a bounded sample of labelled rows, in the order of a hash of the id: ``sample_rows`` at most, and as many as
have ``sample_passages`` passages together; each is read whole. Scoring reads every passage of every text. Null or empty
text is one passage of zeros. If fewer than two labels were seen, all scores are the share of label 1.
Null ids and repeated rows pass through; a row with several labels counts once for each; null labels are not learned from; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.llm.common import lean
from grainmill.llm.shingles import word_bounds, word_hashes
from grainmill.llm.toxicity import labelled_sample

PASSAGE, CLASSES, LAGS = 512, 16, 4
DIM = CLASSES * CLASSES + LAGS + 1


def _classes() -> np.ndarray:
    kind = np.full(256, 14, dtype=np.int64)  # other ASCII
    kind[128:] = 15
    kind[97:123], kind[65:91], kind[48:58], kind[32], kind[10] = 0, 1, 2, 3, 4
    for k, own in enumerate((b"\t\r\x0b\x0c", b".", b",;:", b"'\"`", b"!?", b"|", b"*#", b"%$&", b"()[]{}<>"), 5):
        kind[list(own)] = k
    return kind


_KIND = _classes()


def encode(text: str | None) -> np.ndarray:
    """Passages x DIM."""
    data = np.frombuffer((text or "").encode("utf-8"), dtype=np.uint8)
    n = max(1, -(-len(data) // PASSAGE))
    out = np.zeros((n, DIM), dtype=np.float32)
    if not len(data):
        return out
    kind = _KIND[data]
    pair = np.arange(len(kind) - 1) // PASSAGE * (CLASSES * CLASSES) + kind[:-1] * CLASSES + kind[1:]
    count = np.bincount(pair, minlength=n * CLASSES * CLASSES)[: n * CLASSES * CLASSES].reshape(n, -1)
    out[:, : CLASSES * CLASSES] = np.sqrt(count / np.maximum(1, count.sum(axis=1, keepdims=True)))
    words = word_hashes(text)
    if len(words):
        at = word_bounds(data)[0] // PASSAGE
        in_passage = np.maximum(1, np.bincount(at, minlength=n))
        for lag in range(1, LAGS + 1):
            same = words[lag:] == words[:-lag]
            out[:, CLASSES * CLASSES + lag - 1] = np.bincount(at[lag:][same], minlength=n) / in_passage
        out[:, -1] = in_passage / (PASSAGE / 4)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """Weights: embedding E, e; attention V, U, w; output c, b. ``share``: of label 1, if there was nothing to learn."""

    weights: dict[str, np.ndarray]
    share: float | None = None

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """x: passages of several bags one after another; starts: where each bag starts."""
        w = self.weights
        sizes = np.diff(np.append(starts, len(x)))
        h = np.tanh(x @ w["E"] + w["e"])
        v, u = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        logit = (v * u) @ w["w"]
        logit = logit - np.repeat(np.maximum.reduceat(logit, starts), sizes)
        a = np.exp(logit)
        a = a / np.repeat(np.add.reduceat(a, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return {"h": h, "v": v, "u": u, "a": a, "z": z, "p": _sigmoid(z @ w["c"] + w["b"]), "sizes": sizes}

    def gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, f = self.weights, self.forward(x, starts)
        d = (f["p"] - y) / len(y)
        dz = np.repeat(d[:, None] * w["c"], f["sizes"], axis=0)
        da = (dz * f["h"]).sum(axis=1)
        dlogit = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, starts), f["sizes"]))
        dv = dlogit[:, None] * w["w"] * f["u"] * (1 - f["v"] ** 2)
        du = dlogit[:, None] * w["w"] * f["v"] * f["u"] * (1 - f["u"])
        dh = f["a"][:, None] * dz + dv @ w["V"].T + du @ w["U"].T
        dpre = dh * (1 - f["h"] ** 2)
        return {"E": x.T @ dpre, "e": dpre.sum(axis=0), "V": f["h"].T @ dv, "U": f["h"].T @ du, "w": (f["v"] * f["u"]).T @ dlogit, "c": f["z"].T @ d, "b": np.array([d.sum()])}

    def scores(self, texts: list[str | None], passages: int = 4000) -> list[float]:
        """Texts are scored in portions of about so many passages; one text is never split."""
        if self.share is not None:
            return [self.share] * len(texts)
        out: list[float] = []
        bags: list[np.ndarray] = []
        n = 0
        for i, text in enumerate(texts):
            bags.append(encode(text))
            n += len(bags[-1])
            if n >= passages or i + 1 == len(texts):
                starts = np.cumsum([0, *map(len, bags[:-1])])
                out += self.forward(np.concatenate(bags), starts)["p"].tolist()
                bags, n = [], 0
        return out


def train(x: np.ndarray, sizes: np.ndarray, y: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 25, rate: float = 0.01, batch: int = 128, decay: float = 1e-4, seed: int = 7) -> Model:
    """x: passages of all bags; sizes: passages of each bag; y: labels of the bags."""
    if len(set(y.tolist())) < 2:
        return Model({}, float(y.mean()) if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    model = Model({"E": draw(x.shape[1], hidden), "e": np.zeros(hidden), "V": draw(hidden, gate), "U": draw(hidden, gate), "w": draw(gate), "c": draw(hidden), "b": np.zeros(1)})
    first = {k: np.zeros_like(v) for k, v in model.weights.items()}
    second = {k: np.zeros_like(v) for k, v in model.weights.items()}
    begin, step = np.cumsum(sizes) - sizes, 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            rows = np.concatenate([np.arange(begin[i], begin[i] + sizes[i]) for i in own])
            grad = model.gradients(x[rows].astype(np.float64), np.cumsum(sizes[own]) - sizes[own], y[own])
            step += 1
            for k, g in grad.items():
                g = g + decay * model.weights[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model.weights[k] = model.weights[k] - rate * (1 - epoch / epochs) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 5_000, sample_passages: int = 150_000) -> Model:
    """Learns from labelled rows for which ``may_learn`` holds. The sample's passages, bounded by both limits, come to the driver."""
    sample = labelled_sample(docs, labels, label_col, may_learn, id_col, text_col, sample_rows)
    sizes = sample.select("draw", F.greatest(F.ceil(F.octet_length("text") / PASSAGE), F.lit(1)).alias("n")).orderBy("draw").toArrow()  # of the sample only
    draws, total = sizes.column("draw").to_numpy(), np.cumsum(sizes.column("n").to_numpy())
    if len(total) and total[-1] > sample_passages:
        sample = sample.where(F.col("draw") < int(draws[np.searchsorted(total, sample_passages, side="right")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = [encode(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) for x in bags], pa.int32()), pa.array([x.astype(np.float16).tobytes() for x in bags], pa.binary())], names=["draw", "label", "n", "x"])

    own = sample.select("draw", "label", "text").mapInArrow(lean(run), "draw long, label int, n int, x binary").toPandas().sort_values("draw", kind="stable")
    x = np.frombuffer(b"".join(own.x), dtype=np.float16).reshape(-1, DIM).astype(np.float32)
    return train(x, own.n.to_numpy(dtype=np.int64), (own.label.to_numpy() == 1).astype(float))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, score) for each row of ``docs``; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(batch.column(1).to_pylist()), pa.float64())], names=[id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")
