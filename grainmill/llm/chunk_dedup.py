"""Substring dedup by content-defined chunks cut by a gear rolling hash.

The gear hash of the last 32 bytes is worked out for a whole text at once, by doubling. A chunk ends at the
white space whose hash is the greatest within ``REACH`` bytes on either side, or, where these hold no white space,
at the character of the greatest hash, so cuts depend on nothing but nearby bytes: an insertion moves no later
cut. Stretches without a cut are cut every ``LONGEST`` bytes.
Chunks are identified by a 128-bit digest; of those that occur more than once, in
several texts or in one, every occurrence but the first, by (id, rev, place), is a seed. Seeds are extended to both sides for as long as the text is
equal to that around their first occurrence, in whole characters and words; where extended seeds touch or overlap
they make one span, and spans of ``min_words`` words at least go, where words of over ``REACH`` bytes
count as one for every ``WORD_BYTES`` bytes. Text that is repeated without a whole chunk
in it isn't found.

Null or empty text has no chunks. Rows with a null id are left as they are. Rows that share id and text
count as one document; rows that share the id alone are told apart by the text's checksum. An empty table
gives an empty result. Offsets are in UTF-8 bytes and never within a character.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from grainmill.llm.common import lean, stored
from grainmill.llm.shingles import mix, word_bounds

REACH, LONGEST, WORD_BYTES = 24, 512, 6
#: So many bytes at least are looked at on either side of a seed.
AROUND = 256
_GEAR = (mix(np.arange(11, 267, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_LANES = tuple(mix(np.arange(k, k + 256, dtype=np.uint64)) for k in (7_000, 9_000))
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWER_TABLE: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_IS_BLANK = np.zeros(256, dtype=bool)
_IS_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def gear(data: np.ndarray) -> np.ndarray:
    """The 32-bit gear hash after each byte: h = 2 h + G[byte], of which 32 bytes remain."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        if len(h) > step:
            moved = h[:-step] << np.uint32(step)
            h = h.copy()
            h[step:] += moved
    return h


def _greatest(h: np.ndarray, size: int) -> np.ndarray:
    """The maximum of h[i : i + size] for each i, h taken as 0 behind its end."""
    m, have = np.concatenate((h, np.zeros(size, dtype=h.dtype))), 1
    while have < size:
        step = min(have, size - have)
        m = np.maximum(m[:-step], m[step:])
        have += step
    return m[: len(h)]


def _peaks(h: np.ndarray) -> np.ndarray:
    """Where h is the greatest within REACH on either side."""
    right = np.append(_greatest(h, REACH)[1:], np.uint32(0))
    left = np.append(np.uint32(0), _greatest(h[::-1], REACH)[::-1][:-1])
    return (h > left) & (h >= right)


def hash_cuts(data: np.ndarray) -> np.ndarray:
    """The ends of chunks that the gear hash tells."""
    n = len(data)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    h, blank = gear(data), _IS_BLANK[data]
    at = _peaks(np.where(blank, h, np.uint32(0)))
    before = np.append(0, np.cumsum(blank, dtype=np.int32))
    place = np.arange(n)
    bare = before[np.minimum(place + REACH + 1, n)] == before[np.maximum(place - REACH, 0)]
    if bare.any():  # no white space within reach: the ends of characters
        ends_char = np.append(data[1:] & 0xC0 != 0x80, True)
        at |= bare & _peaks(np.where(ends_char, h, np.uint32(0)))
    ends = np.flatnonzero(at) + 1
    return ends[ends < n]


def cuts(data: np.ndarray) -> np.ndarray:
    """The ends of the chunks of a text's bytes."""
    n = len(data)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    ends = np.append(hash_cuts(data), n)
    gaps = np.diff(ends, prepend=0)
    if (gaps > LONGEST).any():
        more = []
        for start, end in zip((ends - gaps)[gaps > LONGEST].tolist(), ends[gaps > LONGEST].tolist()):
            for at in range(start + LONGEST, end, LONGEST):
                while at < end and data[at] & 0xC0 == 0x80:
                    at += 1
                more.append(at)
        ends = np.unique(np.append(ends, np.array(more, dtype=np.int64)))
    return ends


def _powers(lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWER_TABLE.get(lane, ((), ()))[0]) < n:
        out = []
        for base in (_BASES[lane], pow(_BASES[lane], -1, 2**64)):
            steps = np.full(max(n, 1 << 16), np.uint64(base), dtype=np.uint64)
            steps[0] = 1
            out.append(np.cumprod(steps, dtype=np.uint64))
        _POWER_TABLE[lane] = tuple(out)
    return _POWER_TABLE[lane]


def digests(data: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit digests of each chunk."""
    starts = np.append(0, ends[:-1])
    out = []
    for lane in range(2):
        up, down = _powers(lane, len(data) + 1)
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_LANES[lane][data] * up[: len(data)], out=total[1:])
        out.append(mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)).view(np.int64))
    return out


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, rev, start, end, d1, d2), one for each chunk; rev is the text's checksum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                own = batch.slice(begin, 500)
                rows: list[list[np.ndarray]] = [[] for _ in range(6)]
                for i, text in enumerate(own.column(1).to_pylist()):
                    raw = (text or "").encode("utf-8")
                    data = np.frombuffer(raw, dtype=np.uint8)
                    ends = cuts(data)
                    if not len(ends):
                        continue
                    for k, v in enumerate((np.full(len(ends), i), np.full(len(ends), zlib.crc32(raw)), np.append(0, ends[:-1]), ends, *digests(data, ends))):
                        rows[k].append(v)
                if rows[0]:
                    at, rev, start, end, d1, d2 = map(np.concatenate, rows)
                    yield pa.RecordBatch.from_arrays([own.column(0).take(pa.array(at)), pa.array(rev, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(d1), pa.array(d2)], names=["id", "rev", "start", "end", "d1", "d2"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).where(F.col(id_col).isNotNull()).mapInArrow(lean(run), f"id {kind}, rev long, start int, end int, d1 long, d2 long")


def word_marks(data: np.ndarray) -> np.ndarray:
    """1 at the first byte of each word, and at each sixth after it in words of over REACH bytes, else 0.

    So text without white space is measured by its length.
    """
    marks = np.zeros(len(data), dtype=np.uint8)
    starts, ends = word_bounds(data)
    marks[starts] = 1
    for i in np.flatnonzero(ends - starts > REACH).tolist():
        marks[starts[i] : ends[i] : WORD_BYTES] = 1
    return marks


def _common(a: bytes, b: bytes) -> int:
    """The length of the common prefix."""
    n = min(len(a), len(b))
    return n if a[:n] == b[:n] else int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax())


def _more_left(own: bytes, other: bytes, whole: bool) -> int:
    """How far a seed goes on to the left, in whole characters, and in whole words where there are any within REACH.

    ``whole``: the text begins where ``own`` does.
    """
    k = _common(own[::-1], other[::-1])
    while k and own[len(own) - k] & 0xC0 == 0x80:
        k -= 1
    at = len(own) - k
    if k and not _IS_BLANK[own[at]] and not (whole if at == 0 else _IS_BLANK[own[at - 1]]):
        blank = np.flatnonzero(_IS_BLANK[np.frombuffer(own, np.uint8)[at : at + REACH]])
        k -= int(blank[0]) + 1 if len(blank) else 0
    return k


def _more_right(own: bytes, other: bytes, whole: bool) -> int:
    """The same to the right; ``own`` and ``other`` begin with the seed's last byte."""
    k = _common(own, other)
    while k > 1 and k < len(own) and own[k] & 0xC0 == 0x80:
        k -= 1
    if k > 1 and not _IS_BLANK[own[k - 1]] and not (whole if k == len(own) else _IS_BLANK[own[k]]):
        low = max(0, k - REACH)
        blank = np.flatnonzero(_IS_BLANK[np.frombuffer(own, np.uint8)[low:k]])
        k = low + int(blank[-1]) + 1 if len(blank) else k
    return k - 1


def _surroundings(hash_ends: np.ndarray, n: int, start: int, end: int, low: int, high: int) -> tuple[int, int]:
    """From where to where a text is looked at for a seed in a run of seeds from low to high.

    A cut depends on 56 bytes before and 24 after it, so texts that are equal to beyond the next of them have the
    same chunk next to the seed, and that is a seed then. Of the run itself, AROUND bytes are looked at.
    """
    i, j = np.searchsorted(hash_ends, low), np.searchsorted(hash_ends, high, side="right")
    before = max(0, int(hash_ends[i - 1]) - 64) if i else 0
    after = min(n, int(hash_ends[j]) + 64) if j < len(hash_ends) else n
    return max(0, min(before, start - AROUND) if start - low <= AROUND else start - AROUND), min(n, max(after, end + AROUND) if high - end <= AROUND else end + AROUND)


def _seeds(later: DataFrame) -> DataFrame:
    """Repeated chunks joined to seeds: neighbours that lie as their first occurrences do. low to high is the run of seeds."""
    w = "OVER (PARTITION BY id, rev ORDER BY start)"
    near = f"lag(end) {w} = start"
    same = f"{near} AND lag(origin.id) {w} = origin.id AND lag(origin.rev) {w} = origin.rev AND lag(start - origin.start) {w} = start - origin.start"
    numbered = later.select("*", F.expr(f"CASE WHEN {near} THEN 0 ELSE 1 END AS opens"), F.expr(f"CASE WHEN {same} THEN 0 ELSE 1 END AS parts"))
    numbered = numbered.select("*", F.expr(f"sum(opens) {w} AS run"), F.expr(f"sum(parts) {w} AS part"))
    seeds = numbered.groupBy("id", "rev", "run", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_chunks"), F.min_by("origin", "start").alias("origin"))
    own = "OVER (PARTITION BY id, rev, run)"
    return seeds.select("id", "rev", "start", "end", "n_chunks", "origin", F.expr(f"min(start) {own} AS low"), F.expr(f"max(end) {own} AS high"))


def _contexts(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """The texts around seeds and, with a null origin_id, around their first occurrences; docs: id, text."""
    kind = docs.schema["id"].dataType
    mine = seeds.select("id", "rev", F.struct("start", "end", "low", "high", "n_chunks", F.col("origin.id").alias("origin_id"), F.col("origin.rev").alias("origin_rev"), F.col("origin.start").alias("origin_start")).alias("at"))
    there = [F.expr(e).alias(n) for n, e in (("start", "origin.start"), ("end", "origin.start + end - start"), ("low", "origin.start"), ("high", "origin.start + end - start"))]
    theirs = seeds.select(F.col("origin.id").alias("id"), F.col("origin.rev").alias("rev"), F.struct(*there, F.lit(0).cast("long").alias("n_chunks"), F.lit(None).cast(kind).alias("origin_id"), F.lit(None).cast("long").alias("origin_rev"), F.lit(None).cast("int").alias("origin_start")).alias("at"))
    asked = mine.union(theirs).groupBy("id", "rev").agg(F.collect_set("at").alias("asked"))
    texts = docs.where("id IS NOT NULL AND text IS NOT NULL").select("id", F.crc32(F.col("text").cast("binary")).alias("rev"), "text")
    own_type = to_arrow_type(kind)
    fields = [("rev", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("n_chunks", pa.int64()), ("origin_id", own_type), ("origin_rev", pa.int64()), ("origin_start", pa.int32()), ("words", pa.int32()), ("end_words", pa.int32()), ("size", pa.int32()), ("left", pa.binary()), ("right", pa.binary()), ("marks", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 100):
                part = batch.slice(begin, 100)
                at, rows = [], []
                for i, (rev, text, asked) in enumerate(zip(*(c.to_pylist() for c in part.columns[1:]))):
                    raw = text.encode("utf-8")
                    data = np.frombuffer(raw, dtype=np.uint8)
                    ends, marks = hash_cuts(data), word_marks(data)
                    before = np.append(0, np.cumsum(marks, dtype=np.int64))
                    for a in asked:
                        start, end = a["start"], a["end"]
                        low, high = _surroundings(ends, len(raw), start, end, a["low"], a["high"])
                        own_marks = b"" if a["origin_id"] is None else marks[low:start].tobytes() + marks[end:high].tobytes()
                        at.append(i)
                        rows.append((rev, start, end, a["n_chunks"], a["origin_id"], a["origin_rev"], a["origin_start"], int(before[start]), int(before[end]), len(raw), raw[low:start], raw[end - 1 : high], own_marks))
                if rows:
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), *(pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields))], names=["id", *(n for n, _ in fields)])

    name = kind.simpleString()
    schema = f"id {name}, rev long, start int, end int, n_chunks long, origin_id {name}, origin_rev long, origin_start int, words int, end_words int, size int, left binary, right binary, marks binary"
    return texts.join(asked, ["id", "rev"]).select("id", "rev", "text", "asked").mapInArrow(lean(run), schema)


def _extended(contexts: DataFrame) -> DataFrame:
    """Rows (id, rev, start, end, words, end_words, n_chunks, origin_id, origin_start): seeds extended to all that is equal."""
    kind = contexts.schema["id"].dataType.simpleString()
    # written, so that the join may split what many rows ask for
    there = stored(contexts.where("origin_id IS NULL").select(F.col("id").alias("origin_id"), F.col("rev").alias("origin_rev"), F.col("start").alias("origin_start"), F.col("end").alias("origin_end"), F.col("left").alias("other_left"), F.col("right").alias("other_right")).dropDuplicates(["origin_id", "origin_rev", "origin_start", "origin_end"]))
    mine = contexts.where("origin_id IS NOT NULL").withColumn("origin_end", F.expr("origin_start + end - start"))
    names = ["id", "rev", "start", "end", "words", "end_words", "n_chunks", "origin_id", "origin_start"]
    pairs = mine.join(there, ["origin_id", "origin_rev", "origin_start", "origin_end"]).select(*names, "left", "right", "marks", "size", "other_left", "other_right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                own = batch.slice(begin, 1000)
                start, end, words, end_words, first = ([], [], [], [], [])
                for s, e, ws, we, o, left, right, marks, size, other_left, other_right in zip(*(own.column(k).to_pylist() for k in (2, 3, 4, 5, 8, 9, 10, 11, 12, 13, 14))):
                    a = _more_left(left, other_left, s == len(left))
                    b = _more_right(right, other_right, e - 1 + len(right) == size)
                    start.append(s - a)
                    end.append(e + b)
                    words.append(ws - sum(marks[len(left) - a : len(left)]))
                    end_words.append(we + sum(marks[len(left) : len(left) + b]))
                    first.append(o - a)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), *(pa.array(c, pa.int32()) for c in (start, end, words, end_words)), own.column(6), own.column(7), pa.array(first, pa.int32())], names=names)

    return pairs.mapInArrow(lean(run), f"id {kind}, rev long, start int, end int, words int, end_words int, n_chunks long, origin_id {kind}, origin_start int")


def repeated_spans(docs: DataFrame, min_words: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, rev, start, end, n_words, n_chunks, first_id, first_start, source_ids): the spans that repeat earlier text.

    A chunk counts if it occurs at two places, in texts of one id or within a text too. n_chunks is the number of chunks that the span was found by, first_id
    and first_start say where the text at the span's start occurs first, source_ids where any of those chunks does.
    """
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    every = chunks(named, "id", "text")  # worked out twice, as writing and reading all chunks takes more disk than the job has
    place = F.struct("id", "rev", "start")
    known = every.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("origin")).where("n > 1").drop("n")
    later = every.join(known, ["d1", "d2"]).where(place != F.col("origin")).select("id", "rev", "start", "end", "origin").distinct()
    found = _extended(stored(_contexts(named, stored(_seeds(later))))).distinct()
    w = "OVER (PARTITION BY id, rev ORDER BY start, end DESC, origin_id, origin_start, words, n_chunks"
    runs = found.withColumn("opens", F.expr(f"CASE WHEN max(end) {w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= start THEN 0 ELSE 1 END")).withColumn("run", F.expr(f"sum(opens) {w} ROWS UNBOUNDED PRECEDING)"))
    first = F.min_by(F.struct("origin_id", "origin_start"), F.struct("start", "origin_id", "origin_start")).alias("first")
    spans = runs.groupBy("id", "rev", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.max("end_words") - F.min("words")).cast("long").alias("n_words"), F.sum("n_chunks").alias("n_chunks"), first, F.array_sort(F.collect_set("origin_id")).alias("source_ids"))
    return spans.where(F.col("n_words") >= min_words).select(F.col("id").alias(id_col), "rev", "start", "end", "n_words", "n_chunks", F.col("first.origin_id").alias(f"first_{id_col}"), F.col("first.origin_start").alias("first_start"), "source_ids")


def without_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the spans cut out of their texts; rows and columns, whatever their names, stay as they are."""
    per_doc = spans.groupBy(F.col(id_col).alias("id"), "rev").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row")).withColumn("id", F.col("row").getField(id_col)).withColumn("rev", F.crc32(F.col("row").getField(text_col).cast("binary")))
    joined = packed.join(per_doc, ["id", "rev"], "left").select("row", "spans")
    at, names = docs.columns.index(text_col), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.column(0).flatten()
            texts = columns[at].to_pylist()
            for i, spans in enumerate(batch.column(1).to_pylist()):
                if spans:
                    raw, last, kept = texts[i].encode("utf-8"), 0, []
                    for s in sorted(spans, key=lambda s: s["start"]):
                        kept.append(raw[last : s["start"]])
                        last = s["end"]
                    texts[i] = b"".join([*kept, raw[last:]]).decode("utf-8")
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(lean(run), docs.schema)
