"""Toxicity by maximum-scoring segments of token log-odds, calibrated by extreme-value statistics.

Every word has a score: its log-odds of standing in toxic rather than clean documents, under a Dirichlet prior
in proportion to its overall frequency, less a margin. Words are drawn together by their beginnings: the prefixes of
``LEAST_PREFIX`` letters and more are scored first, and a longer one, or the word itself, moves from its
prefix's log-odds only by as much as its own exceed ``least_z`` standard errors. So words seen seldom or
never take the score of their beginning, most take the margin alone, and words of clean documents count
against toxicity. A linear scan finds all maximal scoring
segments of a document. By Karlin and Altschul, in a clean document of m words about K m exp(-lambda S)
segments reach S by chance; the best r segments together give a tail probability, and its negative logarithm
(the greatest over r) is the document's evidence. A logistic curve turns evidence into a score. Lambda, K and
the curve are fitted on labelled documents by word scores that did not see them, fold by fold, which also tells
which of ``SETTINGS`` to take.

Fitted on a bounded sample of ``sample_rows`` labelled rows (by a hash of the id), of whose words and prefixes those
in two documents or more are learned. Null or empty text has no evidence
and takes the curve's value at 0. If only one label was seen, all scores are 0. Null ids and repeated rows
pass through; a row with several labels counts once for each; rows with a null label or text are not learned from; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.llm.common import lean

WORDS = re.compile(r"[^\W\d_]+")
LEAST_PREFIX, MOST_PREFIX, FOLDS = 4, 7, 3
#: (least z, margin): how sure and how strong log-odds must be; the setting that explains the held-out folds best is taken.
SETTINGS = ((1.5, 0.5), (3.0, 1.5), (3.0, 2.0))


def chain(word: str) -> list[str]:
    """The prefixes of a word, shortest first, and the word."""
    return [*(word[:k] + "*" for k in range(LEAST_PREFIX, min(MOST_PREFIX, len(word) - 1) + 1)), word]


def tokens(text: str) -> set[str]:
    """Words and prefixes, each once: a word that one document repeats proves little."""
    return {x for w in set(WORDS.findall(text.lower())) for x in chain(w)}


def parent(token: str) -> str | None:
    """The longest prefix of a word or prefix."""
    own = token.removesuffix("*")
    size = min(MOST_PREFIX, len(own) - 1)
    return own[:size] + "*" if size >= LEAST_PREFIX else None


def log_odds(names: list[str], t: np.ndarray, c: np.ndarray, prior: float, least_z: float) -> dict[str, float]:
    """Of tokens in t toxic and c clean documents the log-odds, moved from their prefix's by what is significant; 0 is left out where the prefix has it."""
    all_t, all_c = t.sum(), c.sum()
    own = prior * (t + c)  # the prior's weight is this share of all counts
    whole = prior * (all_t + all_c)
    seen = t + c > 0
    t, c, own = t[seen], c[seen], own[seen]
    names = [n for n, s in zip(names, seen.tolist()) if s]
    delta = np.log((t + own) / (all_t + whole - t - own)) - np.log((c + own) / (all_c + whole - c - own))
    error = least_z * np.sqrt(1 / (t + own) + 1 / (c + own))
    out: dict[str, float] = {}
    for k in sorted(range(len(names)), key=lambda k: (not names[k].endswith("*"), len(names[k]))):
        token, above = names[k], parent(names[k])
        while above is not None and above not in out:
            above = parent(above)
        base = out.get(above, 0.0)
        away = float(delta[k]) - base
        moved = math.copysign(max(0.0, abs(away) - float(error[k])), away)
        if moved:
            out[token] = base + moved
    return out


def maximal_segments(items: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of (start, end, score) items in order.

    Linear: each candidate keeps the running total before and behind it and the place of the nearest candidate
    that starts lower, so no candidate is passed over twice, and each is merged at most once.
    """
    found: list[tuple[int, int, float, float, int]] = []  # start, end, total before, total behind, nearest lower
    total = 0.0
    for start, end, score in items:
        before, total = total, total + score
        if score <= 0:
            continue
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                break
            start, before = found[j][0], found[j][2]
            del found[j:]
        found.append((start, end, before, total, j))
    return [(a, b, behind - ahead) for a, b, ahead, behind, _ in found]


@dataclass
class Model:
    """``words``: the log-odds of words and prefixes; what it lacks has those of its longest prefix there, or 0."""

    words: dict[str, float]
    margin: float
    rate: float  # lambda
    scale: float  # K
    curve: tuple[float, float]
    one_label: bool = False

    def __post_init__(self) -> None:
        self._known: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": {}}

    def _word(self, word: str) -> float:
        own = next((self.words[x] for x in reversed(chain(word)) if x in self.words), 0.0) - self.margin
        if len(self._known) < 80_000 and len(word) < 40:
            self._known[word] = own
        return own

    def word_scores(self, text: str) -> np.ndarray:
        own = WORDS.findall(text.lower())
        found = list(map(self._known.get, own))
        if None in found:
            found = [self._word(w) if s is None else s for w, s in zip(own, found)]
        return np.array(found, dtype=np.float64)

    def segments(self, scores: np.ndarray) -> list[tuple[int, int, float]]:
        """The maximal segments by word positions: words of one sign in a row go in together."""
        if not len(scores):
            return []
        edges = np.flatnonzero(np.diff(scores > 0)) + 1
        starts = np.append(0, edges)
        return maximal_segments(list(zip(starts.tolist(), [*(edges - 1).tolist(), len(scores) - 1], np.add.reduceat(scores, starts).tolist())))

    def hits(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """The number of words, and the segments."""
        scores = self.word_scores(text)
        return len(scores), self.segments(scores)

    def evidence(self, n_words: int, segments: list[tuple[int, int, float]]) -> float:
        best, total, log_km, log_factorials = 0.0, 0.0, math.log(self.scale * max(1, n_words)), 0.0
        for r, (_, _, s) in enumerate(sorted(segments, key=lambda x: -x[2]), 1):
            total += self.rate * s - log_km
            if r > 1:
                log_factorials += math.log(r) + math.log(r - 1)
            if total <= 0:
                break
            best = max(best, total - (r - 1) * math.log(max(total, 1.0)) + log_factorials)
        return best

    def calibrate(self, held: list[tuple[int, list[float]]], y: np.ndarray, scores: np.ndarray, times: np.ndarray) -> float:
        """Fits lambda, K and the curve on (words, segment scores) of documents with labels y, and on how often words of clean ones had which scores.

        Gives the loss a document.
        """
        self.rate = decay_rate(scores, times / max(1, times.sum()))
        clean = [h for h, label in zip(held, y) if not label]
        top = sorted((s for _, segments in clean for s in segments), reverse=True)[:100]
        level = top[-1] if top else 0.0
        self.scale = max(1e-6, (len(top) + 1) / (sum(n for n, _ in clean) + 1) * math.exp(min(self.rate * level, 500.0)))
        x = np.array([math.log1p(self.evidence(n, [(0, 0, s) for s in segments])) for n, segments in held])
        self.one_label = len(set(y.tolist())) < 2
        if self.one_label:
            return 0.0
        self.curve = _logistic(x, y)
        p = np.clip(1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * x, -30, 30))), 1e-9, 1 - 1e-9)
        return float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))

    def scores(self, texts: list[str | None]) -> list[float]:
        return [self.score(x)[0] for x in texts]

    def score(self, text: str | None) -> tuple[float, float, int]:
        """Score, evidence, and the number of significant passages."""
        n, segments = self.hits(text or "")
        e = self.evidence(n, segments)
        passages = sum(self.scale * n * math.exp(-self.rate * s) < 0.05 for _, _, s in segments)
        return 0.0 if self.one_label else 1 / (1 + math.exp(-(self.curve[0] + self.curve[1] * math.log1p(e)))), e, passages


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton's method with a slight ridge; the slope is not negative."""
    design, beta = np.column_stack((np.ones_like(x), x)), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hessian = design.T @ (design * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        beta += np.linalg.solve(hessian, design.T @ (y - p) - 1e-3 * beta)
    return float(beta[0]), max(0.0, float(beta[1]))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, may_learn: Column, id_col: str, text_col: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled rows (id, text, label, draw), by a hash of the id; the list of ids is so bounded and broadcast."""
    drawn = labels.where(F.col(label_col).isNotNull() & may_learn).select(id_col, F.col(label_col).cast("int").alias("label"), F.xxhash64(F.col(id_col), F.lit("draw")).alias("draw"))
    chosen = drawn.orderBy("draw", id_col, "label").limit(rows)
    return docs.where(F.col(text_col).isNotNull()).select(id_col, F.col(text_col).alias("text")).join(F.broadcast(chosen), id_col)


def decay_rate(scores: np.ndarray, share: np.ndarray) -> float:
    """Lambda: the positive solution of E[exp(lambda s)] = 1, 64 if there is none."""
    expect = lambda x: float(share @ np.exp(np.minimum(x * scores, 500)))
    low, high = 1e-6, 1.0
    while expect(high) < 1 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if expect(mid) < 1 else (low, mid)
    return high


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 24_000, prior: float = 0.1, settings: tuple[tuple[float, float], ...] = SETTINGS) -> Model:
    """Learns word scores, the chance statistics and the curve from labelled rows for which ``may_learn`` holds."""
    sample = labelled_sample(docs, labels, label_col, may_learn, id_col, text_col, sample_rows).select("label", "text", F.pmod(F.xxhash64(id_col, F.lit("part")), F.lit(FOLDS)).cast("int").alias("fold"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [Counter() for _ in range(2 * FOLDS)]
        for batch in batches:
            for label, text, fold in zip(*(c.to_pylist() for c in batch.columns)):
                n[2 * fold + (label == 1)].update(tokens(text))
        for k, own in enumerate(n):
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array([k] * len(own), pa.int32()), pa.array(list(own.values()), pa.int64())], names=["token", "cell", "n"])

    cells = sample.mapInArrow(lean(count), "token string, cell int, n long")
    counts = cells.groupBy("token").agg(*[F.sum(F.when(F.col("cell") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(2 * FOLDS)])
    found = counts.where(" + ".join(f"n{k}" for k in range(2 * FOLDS)) + " > 1").orderBy("token").toArrow()  # bounded by the sample
    names, n = found.column("token").to_pylist(), np.array([found.column(f"n{k}").to_numpy() for k in range(2 * FOLDS)], dtype=np.float64).reshape(2 * FOLDS, -1)
    if not n[1::2].any() or not n[0::2].any():
        return Model({}, 0.0, 1.0, 1.0, (0.0, 0.0), one_label=True)

    def learn(left_out: int | None) -> list[Model]:
        t, c = (sum(n[2 * k + y] for k in range(FOLDS) if k != left_out) for y in (1, 0))
        odds = {z: log_odds(names, t, c, prior, z) for z in {z for z, _ in settings}}
        return [Model(odds[z], margin, 1.0, 1.0, (0.0, 0.0)) for z, margin in settings]

    by_fold = docs.sparkSession.sparkContext.broadcast([learn(k) for k in range(FOLDS)])  # bounded by the sample
    columns = ["label", "setting", "n", "segments", "scores", "times"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[Counter] = [Counter() for _ in settings]
        array = lambda x: pa.array(x, pa.list_(pa.float64()))

        def made(rows: list[tuple]) -> pa.RecordBatch:
            label, k, size, segments, scores, times = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(k, pa.int32()), pa.array(size, pa.int64()), array(segments), array(scores), array(times)], names=columns)

        for batch in batches:
            rows = []
            for label, text, fold in zip(*(c.to_pylist() for c in batch.columns)):
                for k, model in enumerate(by_fold.value[fold]):
                    scores = model.word_scores(text)
                    rows.append((label, k, len(scores), [s for _, _, s in model.segments(scores)], [], []))
                    if label != 1:
                        kinds[k].update(np.round(scores, 2).tolist())
            if rows:
                yield made(rows)
        yield made([(None, k, 0, [], list(own), list(own.values())) for k, own in enumerate(kinds)])

    measured = sample.mapInArrow(lean(measure), "label int, setting int, n long, segments array<double>, scores array<double>, times array<double>").toArrow().to_pylist()  # bounded by the sample
    losses, models = [], learn(None)
    for k, model in enumerate(models):
        own = [r for r in measured if r["setting"] == k]
        held = [r for r in own if r["label"] is not None]
        scores, times = (np.array([x for r in own for x in r[name]], dtype=np.float64) for name in ("scores", "times"))
        losses.append(model.calibrate([(r["n"], r["segments"]) for r in held], np.array([r["label"] == 1 for r in held], dtype=float), scores, times))
    return models[int(np.argmin(losses))]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, score, evidence, n_passages) for each row of ``docs``; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                own = [shared.value.score(x) for x in part.column(1).to_pylist()]
                s, e, n = zip(*own)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64()), pa.array(e, pa.float64()), pa.array(n, pa.int32())], names=[id_col, "score", "evidence", "n_passages"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double, evidence double, n_passages int")


def passages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", most_expected: float = 0.05) -> DataFrame:
    """Rows (id, first_word, last_word, passage_score, expected): every segment of which chance makes fewer than ``most_expected`` a document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            rows = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                n, segments = own.hits(text or "")
                rows += [(i, a, b, s, e) for a, b, s in segments if (e := own.scale * n * math.exp(-own.rate * s)) < most_expected]
            if rows:
                i, a, b, s, e = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i)), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(s, pa.float64()), pa.array(e, pa.float64())], names=[id_col, "first_word", "last_word", "passage_score", "expected"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, first_word int, last_word int, passage_score double, expected double")


def keep_rows(docs: DataFrame, scorer, below: float | None = None, at_least: float | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text ``scorer`` (a broadcast with ``scores(texts)``) puts outside the bounds."""
    at, names = docs.columns.index(text_col), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                own = batch.slice(start, 2000)
                s = np.array(scorer.value.scores(own.column(at).to_pylist()), dtype=float)
                keep = (s < (np.inf if below is None else below)) & (s >= (-np.inf if at_least is None else at_least))
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in own.columns], names=names)

    return docs.mapInArrow(lean(run), docs.schema)
