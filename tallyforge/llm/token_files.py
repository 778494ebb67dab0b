"""Token ids in Arrow stream files: batches of fixed-size lists, read by memory map without copying.

A folder has one pair of files per shard, shards in ascending document order:
  ids-NNNNNN.arrow    batches of `rows` sequences; `ids` fixed-size list of `width` unsigned ids, `mask` fixed-size list of
                      bits (0 only for the padding that ends a shard)
  docs-NNNNNN.arrow   doc_id, start and n_tokens of each document, start counted from the shard's first id
A shard's documents follow each other without gaps, so a document may span sequences. All batches but a shard's last have
the same number of rows, so sequence i lies in batch i // rows: nothing is searched or decoded.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.shared import committed, open_folder, partitions
from tallyforge.llm.tokens import token_cache

WIDTH, ROWS = 1024, 64
MANIFEST = "shard int, n_docs bigint, n_tokens bigint, n_sequences bigint"


class _Sequences:
    """Cuts a growing run of ids into batches of `ROWS` sequences."""

    def __init__(self, sink, dtype: np.dtype):
        self.kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(self.kind, WIDTH)), ("mask", pa.list_(pa.bool_(), WIDTH))])
        self.writer, self.dtype = pa.ipc.new_stream(sink, self.schema), dtype
        self.waiting, self.n, self.n_sequences = [], 0, 0

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.n += len(ids)
        if self.n >= WIDTH * ROWS:
            ids = np.concatenate(self.waiting)
            whole = len(ids) // (WIDTH * ROWS) * WIDTH * ROWS
            for at in range(0, whole, WIDTH * ROWS):
                self._batch(ids[at : at + WIDTH * ROWS], WIDTH * ROWS)
            self.waiting, self.n = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        if self.n:
            ids = np.zeros(-(-self.n // WIDTH) * WIDTH, self.dtype)
            ids[: self.n] = np.concatenate(self.waiting)
            self._batch(ids, self.n)
        self.writer.close()

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), WIDTH) for x in (ids, mask)]
        self.writer.write_batch(pa.record_batch(lists, schema=self.schema))
        self.n_sequences += len(ids) // WIDTH


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, end_id: int | None = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes every text, ascending by id, into `folder`; returns the manifest, one row per shard.

    Null texts count as empty; null ids come first; rows with the same id follow each other by text. Other columns are left
    out. An empty table gives an empty manifest. A task that runs again replaces its own files.
    """
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, shard = token_cache(vocabulary), TaskContext.get().partitionId()
        end = np.array([] if end_id is None else [end_id], cache.dtype)
        keys, sizes = [], []
        with committed(folder, f"ids-{shard:06d}.arrow") as sink:
            out = _Sequences(sink, cache.dtype)
            for batch in batches:
                keys += batch["id"].tolist()
                for ids in cache.ids(batch["text"].tolist()):
                    out.add(ids)
                    out.add(end)
                    sizes.append(len(ids) + len(end))
            out.close()
        if not keys:
            return
        n = np.array(sizes, np.int64)
        index = pa.table({"doc_id": pa.array([None if pd.isna(k) else int(k) for k in keys], pa.int64()), "start": np.cumsum(n) - n, "n_tokens": n})
        with committed(folder, f"docs-{shard:06d}.arrow") as sink, pa.ipc.new_stream(sink, index.schema) as writer:
            writer.write_table(index)
        yield pd.DataFrame({"shard": [shard], "n_docs": [len(n)], "n_tokens": [int(n.sum())], "n_sequences": [out.n_sequences]})

    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    # the text breaks ties of order only, so that ids alone decide the ranges
    ordered = rows.repartitionByRange(partitions(spark), "id").sortWithinPartitions("id", "text")
    ordered.mapInPandas(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


class TokenFile:
    """Random access to one shard's sequences; ids come from the mapped file as they lie there."""

    def __init__(self, folder: str, shard: int):
        filesystem, root = open_folder(folder)
        name = f"{root}/ids-{shard:06d}.arrow"
        local = getattr(filesystem, "type_name", "") == "local"
        self.source = pa.memory_map(name) if local else filesystem.open_input_file(name)
        self.batches = list(pa.ipc.open_stream(self.source))
        self.ids = [b.column("ids").values.to_numpy(zero_copy_only=True) for b in self.batches]
        with filesystem.open_input_stream(f"{root}/docs-{shard:06d}.arrow") as source:
            self.docs = pa.ipc.open_stream(source).read_all()

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids (a view of the file) and mask (bits of the file) of sequence i."""
        batch, row = divmod(i, ROWS)
        return self.ids[batch][row * WIDTH : (row + 1) * WIDTH], self.batches[batch].column("mask")[row].values

    def run(self, start: int, n: int) -> np.ndarray:
        """n ids from `start` on; a view unless they lie in more than one batch."""
        size, parts = ROWS * WIDTH, []
        while n > 0:
            batch, at = divmod(start, size)
            part = self.ids[batch][at : at + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint32)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document, from the files."""
    shards = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    # one row per shard
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    listed = shards.select("shard", before.alias("first")).repartition(partitions(spark), "shard")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, first in zip(batch["shard"].tolist(), batch["first"].tolist()):
                file = TokenFile(folder, shard)
                start, n = file.docs["start"].to_numpy(), file.docs["n_tokens"].to_numpy()
                crc = [zlib.crc32(file.run(s, k).astype("<u4").tobytes()) for s, k in zip(start.tolist(), n.tolist())]
                yield pd.DataFrame({"doc_id": file.docs["doc_id"].to_pandas(integer_object_nulls=True), "start": start + first, "n_tokens": n, "ids_crc32": crc})

    return listed.mapInPandas(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
