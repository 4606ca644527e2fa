"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

Each permutation gives two values of a document's signature, its minimum and its maximum, so 60
permutations fill 24 bands of five, or at 0.80 thirty bands of four. Steps:

1. Documents with the same set of shingles fall to one representative, by a digest of the set.
2. Representatives that share a band's bucket are candidates. Each is first compared with the bucket's
   least id only (a star, not all pairs): sizes and 8-bit signatures rule out most, the rest are confirmed
   on their full sets.
3. In buckets that then still hold several components, blocks of members are compared with each other,
   those across components confirmed until connected. Blocks bound the memory and the rows dealt out; no
   pair list is made, and no bucket is cut short. In a bucket of over ``CROWD`` members (much text of one
   pattern) those that share a second band meet first, which leaves fewer components; what then still holds
   several is compared in blocks as any other bucket, so a pair that shares one band alone is found at every size.

At the least similarity asked for a pair shares no bucket with probability below 1e-6, and at 1e-9 the
signatures of a confirmed pair would be ruled out.

Null, empty or blank texts have no shingles and are linked with nothing. Rows that share an id are one
node: all they link is one component. Rows with a null id are kept and have no component. Texts of any length are read whole.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from grainmill.llm.common import discard, lean, stored
from grainmill.plans.connected import components
from grainmill.llm.shingles import mix, shingle_set

PERMUTATIONS = 60
BLOCK = 512
#: Members of a hub that one task compares with it; members of a bucket over which those that share a second band come first.
PORTION, CROWD = 1_000, 8_192

_A = (mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (mix(np.arange(1001, PERMUTATIONS + 1001, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minima, then maxima, under each permutation."""
    low = np.full(PERMUTATIONS, 2**32 - 1, dtype=np.uint32)
    high = np.zeros(PERMUTATIONS, dtype=np.uint32)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    for start in range(0, len(x), 4096):
        moved = x[None, start : start + 4096] * _A[:, None] + _B[:, None]
        np.minimum(low, moved.min(axis=1), out=low)
        np.maximum(high, moved.max(axis=1), out=high)
    return np.concatenate((low, high))


def band_size(percent: int) -> int:
    """Of five at most, the most values a band may have for a pair at ``percent`` to share none at 1e-6 at most."""
    return max((b for b in range(1, 6) if (1 - (percent / 100) ** b) ** (2 * PERMUTATIONS // b) <= 1e-6), default=1)


@cache
def least_equal(percent: int) -> int:
    """So many of the values a pair at ``percent`` has in common, but at 1e-9."""
    n, p, below = 2 * PERMUTATIONS, percent / 100, 0.0
    for k in range(n):
        below += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if below > 1e-9:
            return k
    return n


def band_keys(values: np.ndarray, band: int) -> np.ndarray:
    """A 64-bit key for each band."""
    rows = values.reshape(-1, band).astype(np.uint64)
    key = np.arange(1, len(rows) + 1, dtype=np.uint64)
    for k in range(band):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * common >= percent * union, of sorted distinct hashes."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = int((b[at] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int, band: int) -> DataFrame:
    """Rows (id, n_shingles, digest, bands, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                own = batch.slice(start, 1000)
                n, digest, bands, sketch = [], [], [], []
                for text in own.column(1).to_pylist():
                    hashes = shingle_set(text, words)
                    n.append(len(hashes))
                    if len(hashes):
                        values = signature(hashes)
                        digest.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
                        bands.append(band_keys(values, band))
                        sketch.append((mix(values.astype(np.uint64)) & np.uint64(255)).astype(np.uint8).tobytes())
                    else:
                        digest.append(None)
                        bands.append(None)
                        sketch.append(None)
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], names=["id", "n_shingles", "digest", "bands", "sketch"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(lean(run), f"id {kind}, n_shingles long, digest binary, bands array<long>, sketch binary")


def _alike(pairs: DataFrame) -> DataFrame:
    """Of rows with sketch_a and sketch_b, those that agree in ``least`` places or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint8).reshape(-1, 2 * PERMUTATIONS) for k in (2, 3))
                keep = pa.array((a == b).sum(axis=1) >= batch.column(4).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    return pairs.select("a", "b", "sketch_a", "sketch_b", "least").mapInArrow(lean(run), f"a {kind}, b {kind}")


def _confirm_stars(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Of pairs (a, b) those whose full sets are similar. Members of a hub come in salted portions.

    Texts are joined by a shuffle at every size, here and in ``_confirm_blocks``: what is joined to them grows with the input.
    """
    portions = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PORTION).alias("portions"))
    salted = pairs.join(portions, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("portions")).alias("salt"))
    hubs = salted.select("a", "salt").distinct().select("a", "salt", F.col("a").alias("id"))
    ends = stored(salted.select("a", "salt", F.col("b").alias("id")).union(hubs))
    placed = ends.hint("merge").join(docs, "id").repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("id") != F.col("a"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hub = None, []
        for batch in batches:
            found: tuple[list, list] = ([], [])
            for start in range(0, batch.num_rows, 500):
                own = batch.slice(start, 500)
                for a, salt, i, text in zip(*(c.to_pylist() for c in own.columns)):
                    hashes = shingle_set(text, words)
                    if (a, salt) != now:
                        now, hub = (a, salt), []
                    if i == a:
                        hub.append(hashes)
                    elif any(similar(h, hashes, percent) for h in hub):
                        found[0].append(a)
                        found[1].append(i)
            yield pa.RecordBatch.from_arrays([pa.array(x, batch.schema.field(0).type) for x in found], names=["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    return placed.select("a", "salt", "id", "text").mapInArrow(lean(run), f"a {kind}, b {kind}")


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """Runs of rows with the same first ``keys`` columns, each as columns of values."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != now:
                if rows:
                    yield now, list(map(list, zip(*rows)))
                now, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield now, list(map(list, zip(*rows)))


def _sides(columns: list[list], same: bool) -> tuple[list[list], list[list] | None]:
    """The members of the two blocks of a pair, by ``part``; of a block with itself, all and None."""
    if same:
        return columns[1:], None
    own = list(zip(*columns))
    return tuple([list(c) for c in zip(*[r[1:] for r in own if r[0] == p])] for p in (0, 1))


def _close_pairs(x: list[list], y: list[list] | None, percent: int) -> Iterator[tuple[int, int, int]]:
    """Index pairs of members (columns: id, component, n, sketch) across components that may be similar, with their agreement."""
    other = x if y is None else y
    sa, sb = (np.frombuffer(b"".join(z[3]), dtype=np.uint8).reshape(-1, 2 * PERMUTATIONS) for z in (x, other))
    ca, cb, na, nb = np.array(x[1]), np.array(other[1]), np.array(x[2]), np.array(other[2])
    for i in range(len(sa)):
        may = (cb != ca[i]) & (100 * np.minimum(nb, na[i]) >= percent * np.maximum(nb, na[i]))
        if y is None:
            may[: i + 1] = False
        rows = np.flatnonzero(may)
        if len(rows):
            equal = (sb[rows] == sa[i]).sum(axis=1)
            enough = equal >= least_equal(percent)
            for j, e in zip(rows[enough].tolist(), equal[enough].tolist()):
                yield i, j, e


def _block_rows(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Deals the members of each bucket to pairs of blocks (key, i, j), i <= j; ``part`` says on which side."""
    blocked = members.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    sides = F.expr("transform(sequence(0, cast(blocks AS int) - 1), o -> named_struct('i', least(block, o), 'j', greatest(block, o), 'part', cast(block > o AS int)))")
    return blocked.withColumn("at", F.explode(sides)).select("key", F.col("at.i").alias("i"), F.col("at.j").alias("j"), F.col("at.part").alias("part"), "id", "component", "n_shingles", "sketch")


def _in_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """Rows (key, i, j, part, id) of members that may be similar to one of another component."""
    own_type = to_arrow_type(rows.schema["id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, i, j), columns in _grouped(batches, 3):
            x, y = _sides(columns, i == j)
            if not x or y == []:
                continue
            left, right = set(), set()
            for a, b, _ in _close_pairs(x, y, percent):
                left.add(a)
                (left if y is None else right).add(b)
            part = [0] * len(left) + [1] * len(right)
            ids = [x[0][a] for a in sorted(left)] + [y[0][b] for b in sorted(right) if y]
            if ids:
                n = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.int64()), pa.array([i] * n, pa.int32()), pa.array([j] * n, pa.int32()), pa.array(part, pa.int32()), pa.array(ids, own_type)], names=["key", "i", "j", "part", "id"])

    kind = rows.schema["id"].dataType.simpleString()
    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id")
    return dealt.mapInArrow(lean(run), f"key long, i int, j int, part int, id {kind}")


def _confirm_blocks(needed: DataFrame, rows: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) that join components: within each pair of blocks the closest first, until connected."""
    own_type = to_arrow_type(rows.schema["id"].dataType)
    own = rows.select("id", "component", "n_shingles", "sketch").dropDuplicates(["id"])
    placed = needed.join(own, "id").hint("merge").join(docs, "id")
    placed = placed.select("key", "i", "j", "part", "id", "component", "n_shingles", "sketch", "text").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), columns in _grouped((b.slice(s, 200) for b in batches for s in range(0, b.num_rows, 200)), 3):
            x, y = _sides(columns, i == j)
            if not x or y == []:
                continue
            other = x if y is None else y
            parent: dict = {}

            def root(c):
                while parent.get(c, c) != c:
                    c = parent[c]
                return c

            sets: dict = {}
            found = []
            for a, b, _ in sorted(_close_pairs(x, y, percent), key=lambda p: -p[2]):
                ra, rb = root(x[1][a]), root(other[1][b])
                if ra != rb:
                    for side, k, z in ((0, a, x), (0 if y is None else 1, b, other)):
                        if (side, k) not in sets:
                            sets[side, k] = shingle_set(z[4][k], words)
                    if similar(sets[0, a], sets[0 if y is None else 1, b], percent):
                        parent[max(ra, rb)] = min(ra, rb)
                        found.append((x[0][a], other[0][b]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, own_type) for c in zip(*found)], names=["a", "b"])

    kind = rows.schema["id"].dataType.simpleString()
    return placed.mapInArrow(lean(run), f"a {kind}, b {kind}")


def _divided(members: DataFrame, crowds: DataFrame, bands: DataFrame) -> DataFrame:
    """``members`` (key, id, ...) with the crowds divided: a member of a crowd goes to one new key for each other band."""
    there = members.join(crowds, "key").join(bands, "id").withColumn("other", F.explode("bands")).where("other <> key")
    return members.join(crowds, "key", "left_anti").unionByName(there.withColumn("key", F.xxhash64(F.least("key", "other"), F.greatest("key", "other"))).select(members.columns))


def _placed(crowded: DataFrame, of: DataFrame) -> DataFrame:
    """Members (key, id, component) of buckets."""
    return crowded.select("key", "id").join(of, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))


def _across(apart: DataFrame, reps: DataFrame, texts: DataFrame, words: int, percent: int, written: list[DataFrame]) -> DataFrame | None:
    """Links (a, b) that join components within the buckets of ``apart`` (key, id, component), if any may. ``written`` takes the tables to discard."""
    members = stored(apart.join(reps.select("id", "n_shingles", "sketch"), "id"))
    sizes = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    needed = stored(_in_blocks(_block_rows(members, sizes), percent))
    written += [members, needed]
    if needed.isEmpty():
        return None
    written.append(stored(_confirm_blocks(needed, members, texts, words, percent)))
    return written[-1]


def near_duplicates(docs: DataFrame, percent: int = 85, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_shingles, component_id, kept) for each row of ``docs``."""
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = stored(signatures(named, "id", "text", words, band_size(percent)))
    full = signed.where("n_shingles > 0 AND id IS NOT NULL")
    # rows of one digest have the same set, so the same bands and sketch
    reps = stored(full.groupBy("digest").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("n_shingles", "bands", "sketch")]))
    ids = stored(full.select("id", "digest").distinct().join(reps.select("digest", F.col("id").alias("rep")), "digest").select("id", "rep"))
    of_several = ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    shared = ids.join(of_several, "id").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))  # one id, several texts

    cells = reps.select("id", "n_shingles", F.explode("bands").alias("key"))
    buckets = cells.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "n_shingles")).alias("hub")).where("n > 1")
    crowded = stored(cells.join(buckets, "key").select("key", "id", "n_shingles", F.col("hub.id").alias("hub"), F.col("hub.n_shingles").alias("hub_n")))
    fits = F.expr(f"id <> hub AND 100 * least(n_shingles, hub_n) >= {percent} * greatest(n_shingles, hub_n)")
    stars = crowded.where(fits).select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    sketches = reps.select("id", "sketch")
    both = stars.join(sketches.toDF("a", "sketch_a"), "a").join(sketches.toDF("b", "sketch_b"), "b").withColumn("least", F.lit(least_equal(percent)))
    texts = named.where("id IS NOT NULL AND text IS NOT NULL")
    alike = stored(_alike(both))
    links = stored(_confirm_stars(alike, texts, words, percent).union(shared))

    of = components(links)
    mixed = lambda rows: rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high")
    placed = _placed(crowded, of)
    several = stored(mixed(placed).select("key", "n"))
    crowds = several.where(F.col("n") > CROWD).select("key")
    apart, written = placed.join(several.select("key"), "key"), []
    if not crowds.isEmpty():
        divided = stored(_divided(apart, crowds, reps.select("id", "bands")).distinct())
        if (found := _across(divided.join(mixed(divided).select("key"), "key"), reps, texts, words, percent, written)) is not None:
            links = links.union(found)
            of = components(links)
        rest = stored(_placed(crowded.join(crowds, "key", "left_semi"), of))  # now those that share this band alone
        apart = rest.join(mixed(rest).select("key"), "key")
        written += [divided, rest]
    if (found := _across(apart, reps, texts, words, percent, written)) is not None:
        of = components(links.union(found))
    by_id = stored(ids.join(of, ids.rep == of.id, "left").groupBy(ids.id).agg(F.min(F.coalesce("component", "rep")).alias("component")))
    out = signed.select("id", "n_shingles").join(by_id, "id", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    for used in (reps, ids, crowded, alike, several, *written):
        discard(used)
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
