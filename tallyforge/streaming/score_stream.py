"""Scoring of result files as they arrive, with a leaderboard that equals the batch result."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyforge.functions.answers import parse_answer, score_answers
from tallyforge.operators.leaderboard import GROUP


def score_stream(rows: DataFrame, out_dir: str, key: list[str], ts: str = "ts", watermark: str | None = None) -> StreamingQuery:
    """Starts a run over all rows that have arrived: parse, score, drop repeats of a key, add to rows and sums of `out_dir`.

    The state store holds the keys seen, so a repeat in any later batch or run counts nothing (give sessions with very many
    keys the RocksDB store, as `get_session` does). With a watermark it forgets keys that are older, and a repeat after that counts
    again. Every micro-batch owns one folder of scored rows and one of sums, and replaces both when it is run again, so a
    restart after a lost executor or driver adds nothing twice.
    """
    once = rows.dropDuplicates(key) if watermark is None else rows.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(key)
    scored = score_answers(parse_answer(once)).select(*key, *[c for c in GROUP if c not in key], ts, "performance", "exact15")

    def add(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{out_dir}/rows/batch={batch_id}")
        sums = _sums(spark.read.parquet(f"{out_dir}/rows/batch={batch_id}"))
        done = [b for b in _batches(spark, out_dir) if b < batch_id]
        if done:
            sums = merged(spark.read.parquet(f"{out_dir}/sums/batch={done[-1]}").unionByName(sums))
        sums.coalesce(1).write.mode("overwrite").parquet(f"{out_dir}/sums/batch={batch_id}")
        for old in done[:-1]:  # the last one is kept, should this batch run again
            _path(spark, f"{out_dir}/sums/batch={old}", delete=True)

    return (
        scored.writeStream.foreachBatch(add).option("checkpointLocation", f"{out_dir}/checkpoint").trigger(availableNow=True).start()
    )


def _sums(rows: DataFrame) -> DataFrame:
    """Sums and counts by group, which further ones can be added to."""
    return rows.groupBy(*GROUP).agg(
        F.count("*").alias("n_samples"), F.count("performance").alias("n_scored"), F.sum("performance").alias("performance"), F.sum("exact15").cast("bigint").alias("exact15"))


def merged(sums: DataFrame) -> DataFrame:
    return sums.groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in ("n_samples", "n_scored", "performance", "exact15")])


def _path(spark: SparkSession, path: str, delete: bool = False):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if delete:
        return files.delete(at, True)
    return [f.getPath() for f in files.listStatus(at)] if files.exists(at) else []


def _batches(spark: SparkSession, out_dir: str) -> list[int]:
    """Numbers of the batches whose sums are complete."""
    found = [str(p) for p in _path(spark, f"{out_dir}/sums") or []]
    return sorted(int(p.rsplit("=", 1)[1]) for p in found if "batch=" in p and any(str(f).endswith("_SUCCESS") for f in _path(spark, p)))


def scored_rows(spark: SparkSession, out_dir: str) -> DataFrame:
    """Scored rows of a stream so far."""
    return spark.read.parquet(f"{out_dir}/rows").drop("batch")


def leaderboard(spark: SparkSession, out_dir: str) -> DataFrame:
    """Mean performance by group, samples and exact answers, from the last sums: as many rows are read as there are groups."""
    sums = spark.read.parquet(f"{out_dir}/sums/batch={_batches(spark, out_dir)[-1]}")
    return sums.select(*GROUP, (F.col("performance") / F.col("n_scored")).alias("mean_performance"), "n_samples", "exact15")
