"""Language identification by rank-order profiles of letter n-grams.

A language's profile is its ``profile_size`` most frequent n-grams (words padded by a blank at each end), in
order. A text's own most frequent n-grams are ranked the same way, among those that any profile knows, and
the language with the least sum of out-of-place distances wins; an n-gram that a profile lacks is out of
place by the profile's size. Ties go to the lesser language name.

Profiles are fitted on a bounded sample: about ``per_language`` rows of each language, by a hash of the id;
more than ``most_languages`` languages, which no model of bounded size could hold, are an error. Null text, or text without a
letter, is ``und`` with score 0, and so is everything if nothing could be learned. Null ids and repeated
rows pass through row by row, texts of any length are read whole; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS = re.compile(r"[^\W\d_]+").findall


def grams(word: str, longest: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for n in range(1, longest + 1) for i in range(len(padded) - n + 1) if n > 1 or padded[i] != " "]


@dataclass
class Profiles:
    """``ranked``: the n-grams of each language, most frequent first."""

    ranked: dict[str, list[str]]
    size: int
    longest: int
    remember: int = 200_000
    known: dict[str, np.ndarray] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        self.names = sorted(self.ranked)
        self.ids = {g: i for i, g in enumerate(sorted({g for v in self.ranked.values() for g in v}))}
        self.rank = np.full((len(self.names), len(self.ids)), -1, dtype=np.int64)
        for k, name in enumerate(self.names):
            for r, g in enumerate(self.ranked[name]):
                self.rank[k, self.ids[g]] = r

    def __getstate__(self) -> dict:
        return {"ranked": self.ranked, "size": self.size, "longest": self.longest}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def _word(self, word: str) -> np.ndarray:
        get = self.ids.get
        own = np.array([i for g in grams(word, self.longest) if (i := get(g)) is not None], dtype=np.int64)
        if len(self.known) < self.remember and len(word) < 40:
            self.known[word] = own
        return own

    def top(self, text: str) -> tuple[bool, np.ndarray]:
        """Whether the text has a letter, and its most frequent known n-grams."""
        counts = Counter(WORDS(text.lower()))
        if not counts:
            return False, np.zeros(0, dtype=np.int64)
        get = self.known.get
        own = [a if (a := get(w)) is not None else self._word(w) for w in counts]
        weight = np.repeat(np.fromiter(counts.values(), dtype=np.int64, count=len(own)), [len(a) for a in own])
        n = np.bincount(np.concatenate(own), weights=weight, minlength=len(self.ids)) if len(weight) else np.zeros(len(self.ids))
        seen = np.flatnonzero(n)
        return True, seen[np.argsort(-n[seen], kind="stable")][: self.size]

    def predict(self, text: str | None) -> tuple[str, float]:
        letters, own = self.top(text or "")
        if not letters or not self.names:
            return "und", 0.0
        if not len(own):
            return self.names[0], 0.0
        rank = self.rank[:, own]
        away = np.where(rank < 0, self.size, np.abs(rank - np.arange(len(own)))).sum(axis=1)
        best = int(away.argmin())
        return self.names[best], float(1 - away[best] / (self.size * len(own)))


def fit(docs: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 1500, most_languages: int = 500, profile_size: int = 400, longest: int = 4) -> Profiles:
    """Learns profiles from rows of ``docs`` for which ``may_learn`` holds."""
    rows = docs.where(may_learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().limit(most_languages + 1).collect()}
    if len(sizes) > most_languages:
        raise ValueError(f"{lang_col} has more than {most_languages} values")
    if not sizes:
        return Profiles({}, profile_size, longest)
    share = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1_000_000)) / 1_000_000
    sample = rows.where(draw < F.coalesce(share[F.col(lang_col)], F.lit(0.0))).select(lang_col, text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[str, Counter] = {}
        for batch in batches:
            words: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words.setdefault(lang, Counter()).update(WORDS(text.lower()))
            for lang, own in words.items():
                to = n.setdefault(lang, Counter())
                for word, times in own.items():
                    for g in grams(word, longest):
                        to[g] += times
        for lang, own in n.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], names=["lang", "gram", "n"])

    counted = sample.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    ranked: dict[str, list[str]] = {}
    for r in counted.withColumn("r", place).where(F.col("r") <= profile_size).orderBy("lang", "r").collect():
        ranked.setdefault(r.lang, []).append(r.gram)
    return Profiles(ranked, profile_size, longest)


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, lang_pred, score) for each row of ``docs``; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # bounded: languages x profile size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                names, scores = zip(*map(own.predict, part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")
