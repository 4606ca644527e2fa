"""Corpus pipeline: toxicity, quality, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and returns the columns of
``docs``; the last returns packed pieces. Classifiers learn from the labels in ``sf_dir`` of the documents at
hand. Null and empty texts pass the toxicity stage, and the quality stage as its model scores them; they are
nobody's near duplicate, have no repeated passage, and are packed as the end id alone. Rows with a null id
stay. Texts of any length are read whole. Rows that share an id are told apart by their text in the near-duplicate
stage, where of rows equal in both one stays; of equal texts the row of the least id stays. Null labels are not learned
from, and of several labels of one id each counts. Extra columns are kept, whatever
their names, up to the last stage. An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm import chunk_dedup, minmax_dedup, packing, quality, toxicity
from grainmill.llm.common import remainder, stored, table

TOXIC_FROM, GOOD_FROM = 0.5, 0.5
#: Near duplicates share so much of their runs of five words.
NEAR_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under TOXIC_FROM."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 3) != 1)
    return toxicity.keep_rows(docs, spark.sparkContext.broadcast(model), below=TOXIC_FROM)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality scores GOOD_FROM or more; all, if no label could be learned from."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 4) != 2)
    if model.share is not None:
        return docs
    return toxicity.keep_rows(docs, spark.sparkContext.broadcast(model), at_least=GOOD_FROM)


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows (key, row): ``row`` holds all columns of ``docs``; keys are in the order of ids, and of one id there is one for each text.

    Where every id is there once, it is the key itself.
    """
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    ids = packed.where("row.doc_id IS NOT NULL").groupBy("row.doc_id").agg(F.count(F.lit(1)).alias("n"))
    if ids.where("n > 1").isEmpty():
        return packed.select(F.col("row.doc_id").alias("key"), "row")
    place = F.lpad(F.hex(F.col("row.doc_id").cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    own = F.concat_ws(":", place, F.md5(F.coalesce("row.text", F.lit("")).cast("binary")))
    keyed = packed.select(F.when(F.col("row.doc_id").isNotNull(), own).alias("key"), "row")
    return keyed.where("key IS NULL").unionByName(keyed.where("key IS NOT NULL").dropDuplicates(["key"]))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of near duplicates."""
    keyed = _keyed(docs)
    found = minmax_dedup.near_duplicates(keyed.select("key", F.col("row.text").alias("text")), percent=NEAR_PERCENT, id_col="key")
    gone = found.where("NOT kept").select("key").distinct()
    return keyed.join(gone, "key", "left_anti").select("row.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, passages that repeat earlier ones cut out; n_chars follows, where there is one."""
    out = chunk_dedup.without_spans(docs, chunk_dedup.repeated_spans(docs))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.coalesce(F.length("text"), F.lit(0))).cast(docs.schema["n_chars"].dataType))
    return out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their sequence and offset."""
    return packing.pack(packing.cut_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("packing", pack),
]
ORACLE_SQL = None  # no stage of learned models or tokenizers can be put in SQL; tests hold it against plain code


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over all documents; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
