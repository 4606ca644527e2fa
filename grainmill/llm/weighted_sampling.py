"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A text's terms are its words, weighted by count times length. For each of ``SAMPLES`` positions and each
term, r and c are drawn from Gamma(2, 1) and b from U(0, 1) by hashing the term; with
t = floor(ln w / r + b), ln y = r (t - b) and ln a = ln c - ln y - r, the term of least a, with its t, is the
position's sample. Two texts agree in a position with probability their generalised Jaccard similarity,
sum of min weights over sum of max weights.

One shuffle deals out the texts, by ranges of ids; everything up to the fingerprints runs within those
partitions. Each range also gets the first row of the next, so that every row meets its successor. Bounds are approximate quantiles
of the ids, evenly divided in between; rows of an id that fills several quantiles, and rows with a null id, are
divided by a hash of the text, which therefore orders the rows of one id.

Null text counts as empty. An empty or blank text has the one term "", so that equal texts always have
equal fingerprints. Texts of any length are read whole. Rows with a null id come last; rows that share an id are ordered by a hash of the text, then by the text.
Ids are whole numbers, or strings, which are divided by their first seven bytes. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

SAMPLES = 32
ROWS_A_RANGE, MOST_RANGES, QUANTILES = 1_000, 200_000, 256


def _uniform(bits: Column, at: int, size: int) -> Column:
    """(0, 1) from ``size`` bits from bit ``at`` on."""
    own = F.shiftrightunsigned(bits, at).bitwiseAND(F.lit(2**size - 1).cast("long"))
    return (own + F.lit(0.5)) * F.lit(2.0**-size)


def _sample(j: int) -> Column:
    """Of the columns term (hash) and ln_w: ln a in the upper 31 bits, 32 bits of term and t in the lower."""
    x, y = (F.xxhash64("term", F.lit(2 * j + k)) for k in range(2))
    r = -F.log(_uniform(x, 0, 32) * _uniform(x, 32, 32))
    log_c = F.log(-F.log(_uniform(y, 0, 24) * _uniform(y, 24, 24)))
    b = _uniform(y, 48, 16)
    t = F.floor(F.col("ln_w") / r + b)
    log_a = log_c - r * (t - b + 1.0)
    rank = F.floor((F.greatest(F.least(log_a, F.lit(60.0)), F.lit(-700.0)) + 701.0) * F.lit(2.0**21)).cast("long")
    return F.shiftleft(rank, 32).bitwiseOR(F.col("term").bitwiseXOR(t).bitwiseAND(F.lit(0xFFFFFFFF)))


def terms_to_samples(terms: DataFrame, *keys: str) -> DataFrame:
    """Rows (keys, word) -> rows (keys, samples array<long>): the weighted samples of each key's words."""
    weight = F.sum(F.greatest(F.length("word").cast("double"), F.lit(0.01)))
    weighted = terms.groupBy(*keys, F.xxhash64("word").alias("term")).agg(F.log(weight).alias("ln_w"))
    least = weighted.groupBy(*keys).agg(*[F.min(_sample(j)).alias(f"s{j}") for j in range(SAMPLES)])
    return least.select(*keys, F.array(*[F.col(f"s{j}").bitwiseAND(F.lit(0xFFFFFFFF)) for j in range(SAMPLES)]).alias("samples"))


def words(text: Column) -> Column:
    return F.split(F.replace(F.replace(text, F.lit("\n"), F.lit(" ")), F.lit("\t"), F.lit(" ")), " ")


def fingerprint(samples: Column) -> Column:
    return F.array_join(F.transform(samples, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    equal = F.zip_with(a, b, lambda x, y: (x == y).cast("int"))
    return F.aggregate(equal, F.lit(0), lambda n, x: n + x) / F.lit(float(SAMPLES))


def _place(docs: DataFrame, id_col: str) -> Column:
    """A number that is the greater the greater the id is; equal for few ids."""
    if isinstance(docs.schema[id_col].dataType, IntegralType):
        return F.col(id_col).cast("double")
    return F.conv(F.hex(F.substring(F.concat(F.col(id_col).cast("binary"), F.lit(bytes(7))), 1, 7)), 16, 10).cast("double")


def _range_of(docs: DataFrame, id_col: str, n: int, nulls: int) -> tuple[Column, int]:
    """The range of a row of columns ``at`` (its id's place) and ``u`` (of its text, in [0, 1)), and the number of ranges."""
    wanted = min(MOST_RANGES, max(1, -(-n // ROWS_A_RANGE)))
    steps = min(QUANTILES, wanted)
    each = -(-wanted // steps)
    found = docs.select(_place(docs, id_col).alias("at")).approxQuantile("at", [k / steps for k in range(steps + 1)], 0.25 / steps) or [0.0]
    bounds = sorted(set(found))
    # ranges of rows at a bound, which has several if it fills several quantiles, then ranges of rows up to the next
    own = [max(1, (found.count(v) - 1) * each) for v in bounds]
    base = [sum(own[:k]) + each * k for k in range(len(bounds))]
    total = base[-1] + own[-1] + each
    array = lambda values: F.array(*[F.lit(v) for v in values])
    k = F.greatest(F.size(F.filter(array(bounds), lambda v: v <= F.col("at"))), F.lit(1))
    low, high = F.element_at(array(bounds), k), F.element_at(array([*bounds[1:], bounds[-1] + 1.0]), k)
    within = F.least(F.greatest(F.floor((F.col("at") - low) / (high - low) * each), F.lit(0)), F.lit(each - 1))
    place = F.when(F.col("at") == low, F.floor(F.col("u") * F.element_at(array(own), k))).otherwise(F.element_at(array(own), k) + within)
    null_ranges = max(1, -(-nulls // ROWS_A_RANGE))
    return F.when(F.col("at").isNull(), F.lit(total) + F.floor(F.col("u") * null_ranges)).otherwise(F.element_at(array(base), k) + place).cast("int"), total + null_ranges


def with_successors(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (b, seq, guest, id, text, next): partitioned by b; guest rows only stand for the next range's first."""
    n, nulls = docs.agg(F.count(F.lit(1)), F.count(F.when(F.col(id_col).isNull(), 1))).first()
    b, ranges = _range_of(docs, id_col, n, nulls)
    named = docs.select(F.col(id_col).alias("id"), _place(docs, id_col).alias("at"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("hash", F.shiftrightunsigned(F.xxhash64("text"), 1))
    placed = named.withColumn("u", F.col("hash") * F.lit(2.0**-63)).select("id", "text", "hash", b.alias("b"))
    order = Window.orderBy("b")  # over one row for each range: bounded by MOST_RANGES
    heads = placed.groupBy("b").agg(F.min(F.struct("id", "hash")).alias("head")).select("b", "head", F.lag("b").over(order).alias("before"), F.max("b").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("last"))
    home = heads.select(F.col("b").alias("head_b"), "head", F.coalesce("before", "last").alias("other"))
    is_head = (F.col("b") == F.col("head_b")) & F.col("id").eqNullSafe(F.col("head.id")) & (F.col("hash") == F.col("head.hash"))
    here = F.struct(F.col("b"), F.lit(0).alias("guest"))
    there = F.struct(F.col("other").alias("b"), F.lit(1).alias("guest"))
    rows = placed.join(F.broadcast(home), is_head, "left").select("id", "text", "hash", F.explode(F.when(F.col("other").isNotNull(), F.array(here, there)).otherwise(F.array(here))).alias("to"))
    dealt = rows.select("to.b", "to.guest", "id", "text", "hash").repartitionByRange(max(1, min(ranges, -(-n // ROWS_A_RANGE))), "b")
    w = Window.partitionBy("b").orderBy("guest", F.col("id").asc_nulls_last(), "hash", "text")
    return dealt.select("b", F.row_number().over(w).alias("seq"), "guest", "id", "text", F.lead("text").over(w).alias("next"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, fingerprint) for each row of ``docs``."""
    rows = with_successors(docs, id_col, text_col).where("guest = 0")
    sampled = terms_to_samples(rows.select("b", "seq", F.explode(words(F.col("text"))).alias("word")), "b", "seq")
    return rows.select("b", "seq", "id").join(sampled, ["b", "seq"]).select(F.col("id").alias(id_col), fingerprint(F.col("samples")).alias("fingerprint"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has its last floor(n_chars / 2) characters replaced by the first as many of the next row's.
    """
    rows = with_successors(docs, id_col, text_col)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.length("text") - half), F.substr("next", F.lit(1), half))
    kinds = F.when(F.col("guest") == 0, F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("text")), F.struct(F.lit(1).alias("kind"), edited.alias("text"))))
    both = rows.select("b", "seq", F.explode(F.coalesce(kinds, F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("text"))))).alias("of"))
    terms = both.select("b", (F.col("seq") * 2 + F.col("of.kind")).alias("k"), F.explode(words(F.col("of.text"))).alias("word"))
    sampled = terms_to_samples(terms, "b", "k")
    w = Window.partitionBy("b").orderBy("k")
    beside = sampled.select("b", "k", "samples", F.lead("samples", 1).over(w).alias("of_edited"), F.lead("samples", 2).over(w).alias("of_next")).where("k % 2 = 0")
    meta = rows.where("guest = 0").select("b", (F.col("seq") * 2).alias("k"), "id", F.length("text").cast("long").alias("n_chars"), F.sha2(edited.cast("binary"), 256).alias("edited_sha256"))
    s, e = F.col("samples"), F.col("of_edited")
    return meta.join(beside, ["b", "k"]).select(F.col("id").alias(id_col), "n_chars", "edited_sha256", fingerprint(s).alias("fingerprint"), fingerprint(e).alias("edited_fingerprint"), likeness(s, e).alias("near_edited"), likeness(s, F.col("of_next")).alias("near_next"))
