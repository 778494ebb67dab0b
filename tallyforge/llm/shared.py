"""Tables and plain files in the folder that driver and executors share (spark.checkpoint.dir)."""
from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.session import shared_dir, small_batches  # noqa: F401


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder; whoever ends the session may delete it."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to a table in the shared folder and read again: a lost executor costs no earlier stage."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing will read again."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t._stored_at)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans no longer in use; it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Returns memory that this process has freed to the system; Arrow's pool and the C library would keep it for later."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only the GNU library has it
    if trim:
        trim(0)


_KEPT: dict[tuple, Any] = {}


def kept(key: tuple, make: Callable[[], Any]) -> Any:
    """What this Python worker remembers from task to task, until one that does not use it begins."""
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def lean(task: Callable[[Iterator], Iterator], keeps: bool = False) -> Callable[[Iterator], Iterator]:
    """A task's function over batches that gives back, at the end, what its Python worker has freed: workers wait for later tasks.

    It also forgets what other tasks remember (see `kept`), unless it uses that itself (`keeps`).
    """
    @wraps(task)
    def run(batches):
        if not keeps:
            _KEPT.clear()
        yield from task(batches)
        give_back()

    return run


def open_folder(uri: str):
    """File system and path of a shared folder, for tasks that write or read plain files."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


@contextmanager
def committed(uri: str, name: str):
    """An output file that gets its name only when it is complete, so a task that runs twice leaves one whole file."""
    filesystem, root = open_folder(uri)
    filesystem.create_dir(root, recursive=True)
    part = f"{root}/.{name}.{uuid.uuid4().hex}"
    with filesystem.open_output_stream(part) as out:
        yield out
    filesystem.move(part, f"{root}/{name}")


def text_key(text: str = "text") -> Column:
    """A 32-bit hash of the text that tells apart rows with the same id (null and empty differ)."""
    return F.hash(F.col(text).isNull(), F.col(text))


def bit_map(rows: DataFrame, hashed: str, bits: int) -> np.ndarray:
    """2 ** bits bits, packed: set at the upper bits of each 64-bit hash in a column. The map's size is all that reaches the driver."""
    slot = F.shiftrightunsigned(hashed, 64 - bits)
    packed = rows.select(F.shiftright(slot, 3).cast("int").alias("byte"), F.pow(F.lit(2), slot % 8).cast("int").alias("bit"))
    by_page = packed.groupBy("byte").agg(F.bit_or("bit").alias("bits")).groupBy(F.shiftright("byte", 12).alias("page")).agg(F.collect_list(F.struct("byte", "bits")).alias("rows"))

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for page, found in zip(batch["page"], batch["rows"]):
                out = np.zeros(4096, np.uint8)
                for r in found:
                    out[r["byte"] & 4095] = r["bits"]
                yield pd.DataFrame({"page": [page], "bits": [out.tobytes()]})

    out = np.zeros(max(1 << bits >> 3, 4096), np.uint8)
    for page, raw in by_page.mapInPandas(lean(fill), "page int, bits binary").collect():
        out[page * 4096 : (page + 1) * 4096] = np.frombuffer(raw, np.uint8)
    return out


def in_map(bits: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Which of the hashes (unsigned) may be in the map; those that are always are."""
    slot = (hashed >> np.uint64(64 - (len(bits).bit_length() + 2))).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
