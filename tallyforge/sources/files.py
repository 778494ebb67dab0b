"""Reading and writing problem tables, text corpora, result files, token tables and logs."""
from __future__ import annotations

import csv
import uuid
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.constants import DOCUMENT_SEPARATOR
from tallyforge.functions.text import _col

PROBLEM_SUFFIXES = (".csv", ".csv.gz")
#: What stands between task and model in the names of result files.
RESULT_PATTERN = "_decimal_uniform_test_10k_shuffle_"


def _strings(columns: list[str]) -> str:
    return ", ".join(f"`{c}` STRING" for c in columns)


#: Rows of result files that one task sorts.
SLICE = 1 << 18

#: Offsets of at most so many file blocks are sent to all tasks; beyond that they are joined like any table.
BLOCKS = 200_000


def with_row_index(raw: DataFrame, name: str = "row_idx", across: bool = False) -> DataFrame:
    """Rows of a file scan with `file` and their number in it, from 0; with `across`, files are counted on in the order of their paths.

    Files stay splittable: the rows of each block are counted, the counts of earlier blocks added up, and a row has the number
    inside its block on top. `raw` is what `spark.read` returned.
    """
    rows = raw.select(
        "*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    blocks = rows.groupBy(F.col("file").alias("_file"), F.col("_block").alias("_at")).agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*([F.lit(0)] if across else ["_file"])).orderBy("_file", "_at").rowsBetween(Window.unboundedPreceding, -1)
    shift = blocks.select("_file", "_at", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    if raw.rdd.getNumPartitions() + len(raw.inputFiles()) <= BLOCKS:
        shift = F.broadcast(shift)
    met = rows.join(shift, (F.col("file") == F.col("_file")) & (F.col("_block") == F.col("_at")))
    return met.withColumn(name, F.col("_id") + F.col("_shift")).drop("_file", "_block", "_at", "_id", "_shift")


def read_problems(spark: SparkSession, paths: str | list[str], columns: list[str] | None = None, row_idx: bool = False, across: bool = False) -> DataFrame:
    """Problem files (.csv or .csv.gz with header) as text columns; only the wanted columns are parsed.

    With `row_idx`, also `file` and the row's number, see `with_row_index`. A gzip file is one split, so the rows of such files
    are spread over the cluster right after reading; others are read in splits.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    for p in paths:
        if not p.endswith(PROBLEM_SUFFIXES) and "." in p.rsplit("/", 1)[-1]:
            raise ValueError(f"unsupported file type: {p}")
    raw = spark.read.option("header", True).option("escape", '"').option("multiLine", False).csv(paths)
    missing = [c for c in columns or [] if c not in raw.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    wanted = [F.col(f"`{c}`") for c in columns or raw.columns]
    out = with_row_index(raw, "row_idx", across).select(*wanted, "file", "row_idx") if row_idx else raw.select(*wanted)
    if any(f.endswith(".gz") for f in raw.inputFiles()):
        out = out.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return out


def read_documents(spark: SparkSession, path: str, text: str = "text") -> DataFrame:
    """Text column of a Parquet folder."""
    return spark.read.parquet(path).select(F.col(text).alias("text"))


def read_text_corpus(spark: SparkSession, path: str, sep: str = DOCUMENT_SEPARATOR) -> DataFrame:
    """One row per document of a text file whose documents are joined by a separator."""
    return spark.read.option("lineSep", sep).text(path).select(F.col("value").alias("text"))


#: Readers by type of data set; each takes a session, a path and its own options.
READERS = {"prompts": read_problems, "documents": read_documents, "text": read_text_corpus}


def read_dataset(spark: SparkSession, kind: str, path: str, **options) -> DataFrame:
    """A data set of a registered type."""
    if kind not in READERS:
        raise ValueError(f"unknown type of data set: {kind}; known are {', '.join(sorted(READERS))}")
    return READERS[kind](spark, path, **options)


def write_text_corpus(df: DataFrame, path: str, sep: str = DOCUMENT_SEPARATOR, mode: str = "errorifexists") -> None:
    df.select("text").write.mode(mode).option("lineSep", sep).text(path)


def count_label(n: Column | int) -> Column:
    """Short form of a row count: whole millions as M, whole thousands as k."""
    n = F.lit(n) if isinstance(n, int) else n
    whole = lambda d, mark: F.concat(F.floor(n / d).cast("string"), F.lit(mark))
    return F.when(n >= 1_000_000, whole(1_000_000, "M")).when(n >= 1_000, whole(1_000, "k")).otherwise(n.cast("string"))


def problem_name(task: str, distribution: str, split: str, n: int, suffix: str = "") -> str:
    """Name of a problem set: task, distribution, optional suffix, split and short row count."""
    label = f"{n // 1_000_000}M" if n >= 1_000_000 else f"{n // 1_000}k" if n >= 1_000 else str(n)
    return "_".join(p for p in (task, distribution, suffix, split, label) if p)


def write_problems(df: DataFrame, path: str, split: str, mode: str = "errorifexists") -> None:
    """CSV with header; gzip except for the test split. Rows keep the order of the partitions."""
    df.write.mode(mode).option("header", True).option("escape", '"').option("compression", "none" if split == "test" else "gzip").csv(path)


def parse_file_name(name: Column | str, pattern: str = RESULT_PATTERN) -> Column:
    """Task, model and reasoning of a result file name; null when the name does not fit.

    Reasoning is what follows the last `_re_`; a double underscore in the model stands for a slash.
    """
    full = rf"^([A-Za-z]+){pattern}(.+)_re_([A-Za-z0-9]+)\.csv$"
    name = _col(name)
    part = lambda i: F.regexp_extract(name, full, i)
    dims = F.struct(part(1).alias("task"), F.replace(part(2), F.lit("__"), F.lit("/")).alias("model"), part(3).alias("reasoning"))
    return F.when(name.rlike(full), dims)


def _headers(spark: SparkSession, glob: str, fits: Column) -> DataFrame:
    """(file, header): the first line of every result file."""
    lines = spark.read.text(glob).where(fits)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"))
    return lines.where("at = 0").groupBy("file").agg(F.min_by("value", "id").alias("header"))


def discover_results(spark: SparkSession, glob: str, pattern: str = RESULT_PATTERN) -> DataFrame:
    """All result files in a folder or behind a glob, with their dimensions and a row number per file.

    Every file is read by one task, as its answers may hold line breaks, and all of them in one scan by place; each column is
    then named by the file's own header, and the columns of all headers are united. Only the different headers reach the
    driver, never paths or rows. Files with other names are skipped, as are a file's own columns with the names of dimensions.
    """
    fits = parse_file_name(F.col("_metadata.file_name"), pattern).isNotNull()
    headers = _headers(spark, glob, fits)
    kinds = sorted(r["header"] for r in headers.select("header").distinct().collect())
    if not kinds:
        raise ValueError(f"no result files behind {glob}")
    names = [next(csv.reader([k])) for k in kinds]
    places = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])
    kind_of = headers.select(F.col("file").alias("_f"), places[F.col("header")].alias("_kind"))
    schema = ", ".join(f"_c{i} STRING" for i in range(max(map(len, names))))
    raw = spark.read.schema(schema).option("escape", '"').option("multiLine", True).csv(glob)
    rows = with_row_index(raw.where(fits), "_line")
    if len(raw.inputFiles()) <= BLOCKS:
        kind_of = F.broadcast(kind_of)
    rows = rows.where("_line > 0").join(kind_of, F.col("file") == F.col("_f"))
    own = ("task", "model", "reasoning_effort", "file", "row_idx")
    united = [c for c in dict.fromkeys(c for n in names for c in n) if c not in own]
    value = lambda c: F.coalesce(*[F.when(F.col("_kind") == i, F.col(f"_c{n.index(c)}")) for i, n in enumerate(names) if c in n])
    dims = parse_file_name(F.element_at(F.split(F.col("file"), "/"), -1), pattern)
    out = rows.select(*[value(c).alias(c) for c in united], dims.alias("_d"), "file", (F.col("_line") - 1).alias("row_idx"))
    return out.select(*[F.col(f"`{c}`") for c in united], "_d.task", "_d.model", F.col("_d.reasoning").alias("reasoning_effort"), "file", "row_idx")


def write_result_files(df: DataFrame, folder: str, order: list[str], columns: list[str], pattern: str = RESULT_PATTERN) -> int:
    """Result files, one for each task, model and reasoning of df, named by them, rows in the given order; returns their number.

    Tasks sort and write slices of at most about SLICE rows each, whatever the size of a file; then the slices of a file are
    copied one after another, and the file gets its name when it is complete.
    """
    spark = df.sparkSession
    name = F.concat("task", F.lit(pattern), "model", F.lit("_re_"), "reasoning", F.lit(".csv"))
    heads = [c.strip("`") for c in columns]
    rows = df.select(name.alias("_name"), *[F.col(c).cast("string").alias(f"_c{i}") for i, c in enumerate(columns)], *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    keys = [f"_o{i}" for i in range(len(order))]
    slices = max(1, -(-df.count() // SLICE))
    sorted_rows = rows.repartitionByRange(slices, "_name", *keys).sortWithinPartitions("_name", *keys).drop(*keys)
    parts = f".slices-{uuid.uuid4().hex}"

    def opened():
        from pyarrow import fs

        filesystem, root = fs.FileSystem.from_uri(folder if ":/" in folder else f"file://{folder}")
        filesystem.create_dir(f"{root}/{parts}", recursive=True)
        return filesystem, root

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, root = opened()
        open_name, out, part = None, None, ""
        nth = TaskContext.get().partitionId()
        for batch in batches:
            for file, own in batch.groupby("_name", sort=False):
                if file != open_name:
                    if out is not None:
                        out.close()
                        yield pd.DataFrame({"_name": [open_name], "nth": [nth], "part": [part]})
                    open_name, part = file, f"{root}/{parts}/{uuid.uuid4().hex}"
                    out = filesystem.open_output_stream(part)
                out.write(own.drop(columns="_name").to_csv(index=False, header=False).encode())
        if out is not None:
            out.close()
            yield pd.DataFrame({"_name": [open_name], "nth": [nth], "part": [part]})

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, root = opened()
        open_name, out, whole, n = None, None, "", 0
        for batch in batches:
            for file, part in zip(batch["_name"], batch["part"]):
                if file != open_name:
                    if out is not None:
                        out.close()
                        filesystem.move(whole, f"{root}/{open_name}")
                    open_name, whole = file, f"{root}/{parts}/{uuid.uuid4().hex}"
                    out, n = filesystem.open_output_stream(whole), n + 1
                    out.write((",".join(heads) + "\n").encode())
                with filesystem.open_input_stream(part) as source:
                    while piece := source.read(1 << 20):
                        out.write(piece)
        if out is not None:
            out.close()
            filesystem.move(whole, f"{root}/{open_name}")
        yield pd.DataFrame({"n": [n]})

    written = sorted_rows.mapInPandas(write, "_name string, nth int, part string")
    joined = written.repartition("_name").sortWithinPartitions("_name", "nth").mapInPandas(join, "n bigint")
    n = joined.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{parts}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def run_pairs(names: DataFrame, col: str = "file") -> DataFrame:
    """First and second run files that belong together, and the name of their merge."""
    stem = F.regexp_extract(col, r"^(.*)_H[12]\.csv$", 1)
    t = names.filter(F.lower(col).contains("gemini")).select(stem.alias("stem"), F.regexp_extract(col, r"_(H[12])\.csv$", 1).alias("run"), F.col(col).alias("f"))
    g = t.filter("stem <> ''").groupBy("stem").pivot("run", ["H1", "H2"]).agg(F.first("f"))
    return g.filter("H1 IS NOT NULL AND H2 IS NOT NULL").select("H1", "H2", F.concat("stem", F.lit("_high.csv")).alias("merged"))


def union_results(*dfs: DataFrame, numeric: list[str] = ()) -> DataFrame:
    """All rows under the union of the columns; numeric columns are coerced, what is no number or absent is null."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
    for c in numeric:
        out = out.withColumn(c, F.col(f"`{c}`").cast("string").try_cast("double") if c in out.columns else F.lit(None).cast("double"))
    return out


def content_key(df: DataFrame, columns: list[str] | None = None, vocabulary: str = "", negative: bool = True, hashed: Column | None = None) -> DataFrame:
    """One row with a key of the whole content, whatever its order; equal rows count every time. `hashed` replaces the hash of a row."""
    columns = columns or df.columns
    # the hash skips nulls, so each column also says whether it is one
    h = F.xxhash64(*[x for c in columns for x in (F.col(c).isNull(), F.col(c))]) if hashed is None else hashed
    g = df.agg(F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x"), F.count("*").alias("n"))
    text = F.concat_ws("|", F.col("s").cast("string"), F.col("x").cast("string"), F.col("n").cast("string"), F.lit(vocabulary))
    return g.select(F.concat(F.sha2(text, 256), F.lit("" if negative else "_pos")).alias("content_key"), "n")


def write_tokens(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Packed contexts as Parquet by source, in context order inside each file."""
    df.repartition("source", F.floor(F.col("context_idx") / 4096)).sortWithinPartitions("source", "context_idx").write.mode(mode).partitionBy("source").parquet(path)


def append_tokens(df: DataFrame, path: str, chunk: int, source: str = "source", index: str = "context_idx") -> None:
    """Adds a chunk of packed contexts, numbered from 0 in each source, to a token table; a chunk written again replaces itself.

    The rows go to a folder of their own version. Only then does a line of the commit manifest name that version with its
    contexts and tokens per source, so readers see a chunk whole or not at all, and what a lost writer left is never read.
    One writer at a time; chunks are read in the order of their numbers, whenever they came.
    """
    spark = df.sparkSession
    version = uuid.uuid4().hex
    data = f"{path}/data/chunk={chunk}/version={version}"
    df.repartition(source, F.floor(F.col(index) / 4096)).sortWithinPartitions(source, index).write.parquet(data)
    turn = spark.read.parquet(f"{path}/manifest").agg(F.max("turn")).first()[0] + 1 if _exists(spark, f"{path}/manifest") else 0
    written = spark.read.parquet(data).groupBy(F.col(source).alias("source")).agg(F.count("*").alias("contexts"), F.sum(F.size("tokens")).cast("bigint").alias("tokens"))
    line = written.agg(F.collect_list(F.struct("source", "contexts", "tokens")).alias("sizes"))
    line = line.select(F.lit(chunk).alias("chunk"), F.lit(version).alias("version"), F.lit(turn).alias("turn"), "sizes")
    line.coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def token_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(chunk, version, source, contexts, tokens, first_context, first_token) of the chunks as they stand."""
    lines = spark.read.parquet(f"{path}/manifest")
    now = lines.groupBy("chunk").agg(F.max_by(F.struct("version", "sizes"), "turn").alias("v"))
    sizes = now.select("chunk", "v.version", F.inline("v.sizes"))
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    first = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    return sizes.select("*", first("contexts").alias("first_context"), first("tokens").alias("first_token"))


def read_tokens(spark: SparkSession, path: str, source: str = "source", index: str = "context_idx") -> DataFrame:
    """The contexts of all chunks, numbered on from chunk to chunk in each source."""
    at = token_manifest(spark, path).select(F.col("chunk").alias("_c"), F.col("version").alias("_v"), F.col("source").alias("_s"), "first_context")
    rows = spark.read.option("basePath", f"{path}/data").parquet(f"{path}/data")
    met = rows.join(at, (F.col("chunk") == F.col("_c")) & (F.col("version") == F.col("_v")) & F.col(source).eqNullSafe(F.col("_s")))
    return met.withColumn(index, F.col(index) + F.col("first_context")).drop("chunk", "version", "_c", "_v", "_s", "first_context")


def append_metrics(df: DataFrame, path: str) -> None:
    """Appends long metric rows to a log."""
    df.write.mode("append").parquet(path)


def snapshot_long(df: DataFrame, path: str, reuse: bool = False) -> DataFrame:
    """The long result table, written once and read back; with `reuse` an existing one is only read."""
    spark = df.sparkSession
    if not (reuse and _exists(spark, path)):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
