"""Documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with their columns; the last returns the pieces of
packed sequences. A stage's rows are written and read again before the next.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm import decontaminate, language_id, packing, simhash, suffix_dedup
from tallyforge.llm.shared import small_batches, stored, text_key

ORACLE_SQL = None


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows as a struct beside their id and a hash of their text, whatever other columns there are."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.select("row", F.col("row.doc_id").cast("bigint").alias("key"), F.col("row.text").alias("text")).withColumn("hash", text_key()).drop("text")


def _same(found: DataFrame):
    return F.col("key").eqNullSafe(found["doc_id"]) & (F.col("hash") == found["tk"])


#: A text further than this from every codeword is of no language. A text that tells nothing is log(2) = 0.69 from all of them.
FURTHEST = 0.55


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents and rejects those of no language: null texts, texts without a letter, and texts whose
    loss to the nearest codeword is above FURTHEST."""
    small_batches(spark)
    model = language_id.train(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language_id.predicted(model)
    return docs.where((found["lang_pred"] != language_id.UNDETERMINED) & (found["loss"] <= FURTHEST))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each SimHash component; of rows with equal id and text, one."""
    small_batches(spark)
    kept = simhash.least_of_components(docs, words=4, radius=4)
    rows = _keyed(docs).join(kept, _same(kept), "left_semi")
    first = F.row_number().over(Window.partitionBy("key", "hash").orderBy(F.xxhash64("row")))
    return rows.withColumn("nth", first).where("nth = 1").select("row.*")


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out strings of 200 bytes or more that stand in two places; documents of which nothing is left are dropped."""
    small_batches(spark)
    rows = suffix_dedup.cleaned(docs, 200, decoded=True)
    cut = F.size("spans") > 0
    text = F.when(cut, F.col("kept")).otherwise(F.col("row.text"))
    changed = rows.where(~cut | (F.col("kept") != "")).withColumn("row", F.col("row").withField("text", text))
    if "n_chars" in docs.columns:
        n = F.length("row.text").cast(docs.schema["n_chars"].dataType)
        changed = changed.withColumn("row", F.col("row").withField("n_chars", F.when(cut, n).otherwise(F.col("row.n_chars"))))
    return changed.select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of a benchmark item."""
    small_batches(spark)
    found = decontaminate.overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "tk").distinct()
    return _keyed(docs).join(found, _same(found), "left_anti").select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 token ids with their sequence and their place in it."""
    small_batches(spark)
    # workers that earlier stages left hold memory of their own, so each remembers fewer words than it would alone
    pieces = packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, context=1024, remembered=200_000)
    return packing.pack(stored(pieces, "packed-pieces"), 1024)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", remove_repeats),
    ("benchmark", drop_contaminated),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's rows are written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
