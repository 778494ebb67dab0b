"""One query per numbered operator, each over its whole table."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import context_mixing, decontaminate, hard_negatives, language_id, packing, quality_rules, simhash, suffix_dedup, token_counts, token_files, url_filter, warc, whitening
from tallyforge.llm.shared import scratch, small_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: (verdict, rule) of the URL filter.
URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_filter.rule(*r) for r in URL_RULES]
    return url_filter.filtered(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict", "score")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identified(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "token-files")
    token_files.write_tokens(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_files.read_documents(spark, folder)


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return suffix_dedup.digests(table(spark, sf_dir, "documents"), length=200)


def op5_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "first_word", "n_words", "n_equal")


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, context=1024)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    archives = warc.write_archives(table(spark, sf_dir, "pages"), folder, least=0)
    records = warc.read_archives(spark, folder, archives)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.judged(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def drawn_edits(docs: DataFrame, per_document: int = 3) -> DataFrame:
    """Edits (doc_id, seq, start, length, insert) drawn from each document by hash: an insertion, a deletion and a replacement in turn.

    What is inserted is a run of the document's own text.
    """
    size = F.length("text")
    draw = lambda i, what: F.pmod(F.xxhash64("doc_id", F.lit(i), F.lit(what)), size + 1).cast("int")
    changes = [
        F.struct(
            F.lit(i).cast("bigint").alias("seq"), draw(i, "start").cast("bigint").alias("start"), F.lit((0, 20, 15)[i % 3]).cast("bigint").alias("length"),
            F.when(F.lit(i % 3 == 1), "").otherwise(F.substr("text", draw(i, "from") + 1, F.lit(12))).alias("insert"))
        for i in range(per_document)]
    return docs.where("text is not null").select("doc_id", F.inline(F.array(*changes)))


def op9_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    vocabulary, pattern = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    trees = docs.select("doc_id", "text", token_counts.tree(vocabulary, pattern).alias("tree"))
    after = token_counts.apply_edits(trees, drawn_edits(docs), vocabulary, pattern)
    return after.select("doc_id", token_counts.n_tokens().alias("n_tokens"), F.length("text").cast("bigint").alias("n_chars"), "n_edits", "n_read")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", label, "embedding", scale=256)
    return hard_negatives.hard_negatives(rows, F.col("id") % 100 == 0)


def op12_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return context_mixing.scored(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(whitening.shifted_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", scale=64, shift=1_000_000), components=16)


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_language_id, op3_token_files, op4_suffix_array, op5_spaced_seeds, op6_pack, op7_warc, op8_quality_rules, op9_edit_counts, op10_simhash, op11_hard_negatives, op12_context_mixing, op13_whitening)}
ORACLE: dict[str, str] = {"op7_warc": warc.ORACLE, "op8_quality_rules": quality_rules.ORACLE, "op11_hard_negatives": hard_negatives.ORACLE}
