"""Queries on problem tables: sources, grids, generators, prompts, list statistics, subsets."""
from __future__ import annotations

import uuid

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge import constants as C
from tallyforge.operators import generate as G
from tallyforge.operators import prompts as P
from tallyforge.plans.number_queries import KEY, KEY_SQL
from tallyforge.plans.registry import query, table
from tallyforge.plans.views import view, with_views
from tallyforge.session import shared_dir
from tallyforge.sources import files as S


def _folder(spark, name: str) -> str:
    """Folder of this application in the shared folder; a second run of a query replaces its files."""
    return f"{shared_dir(spark)}/tallyforge-{spark.sparkContext.applicationId}/{name}"


# ---- sources ----

_PROBLEM_SQL = with_views("v_problems") + "SELECT num1, total AS answer, count(*) AS n FROM v_problems GROUP BY ALL"


@query("scan_prune", _PROBLEM_SQL)
def scan_prune(spark, sf):
    path = _folder(spark, "scan_prune")
    S.write_problems(view(spark, sf, "v_problems").select("num1", "num2", "operator", F.col("total").alias("answer")), path, "train", "overwrite")
    return S.read_problems(spark, path, ["num1", "answer"]).groupBy("num1", "answer").agg(F.count("*").alias("n"))


#: Problems in a file, as a task sorts one.
LINES = 1 << 18
_LINE = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_quantity"


@query("problem_lines", with_views("v_problems") + f"SELECT row_number() OVER (ORDER BY {_LINE}) - 1 AS row_idx, num1, operator, num2, total FROM v_problems")
def problem_lines(spark, sf):
    """Problems written in order to several files; a row's index is its line in all of them."""
    path = _folder(spark, "problem_lines")
    order = _LINE.split(", ")
    files = max(4, -(-table(spark, sf, "lineitem").count() // LINES))
    t = view(spark, sf, "v_problems").repartitionByRange(files, *order).sortWithinPartitions(*order)
    S.write_problems(t.select("num1", "operator", "num2", "total"), path, "test", "overwrite")
    return S.read_problems(spark, path, row_idx=True, across=True).drop("file")


@query("discovered_results", with_views("v_results") + f""",
  t AS (SELECT *, row_number() OVER (PARTITION BY task, model, reasoning ORDER BY {_LINE}) - 1 AS row_idx FROM v_results)
SELECT task, replace(model, '__', '/') AS model, reasoning AS reasoning_effort, row_idx, answer, nullif(raw_response, '') AS raw_response,
  CASE WHEN reasoning <> 'high' THEN CAST(tokens AS VARCHAR) END AS tokens, CASE WHEN reasoning = 'high' THEN CAST(difficulty_sd AS VARCHAR) END AS "usage.cost" FROM t""")
def discovered_results(spark, sf):
    """Result files under two headers and some of another name, found and read back with their dimensions and row numbers."""
    path = f"{_folder(spark, 'discovered_results')}-{uuid.uuid4().hex}"
    t = view(spark, sf, "v_results").withColumn("usage.cost", F.col("difficulty_sd").cast("string"))
    order = _LINE.split(", ")
    S.write_result_files(t.filter("reasoning <> 'high'"), path, order, ["answer", "raw_response", "tokens"])
    S.write_result_files(t.filter("reasoning = 'high'"), path, order, ["`usage.cost`", "raw_response", "answer"])
    S.write_result_files(t.filter("l_linenumber = 7"), path, order, ["answer"], "_some_other_set_")
    return S.discover_results(spark, path).drop("file")


@query("scan_documents", "SELECT md5(text) AS text_md5, count(*) AS n FROM documents GROUP BY ALL")
def scan_documents(spark, sf):
    return S.read_documents(spark, f"{sf}/documents.parquet").groupBy(F.md5("text").alias("text_md5")).agg(F.count("*").alias("n"))


@query("text_corpus_roundtrip", "SELECT md5(text) AS text_md5, count(*) AS n FROM documents GROUP BY ALL")
def text_corpus_roundtrip(spark, sf):
    path = _folder(spark, "text_corpus")
    S.write_text_corpus(S.read_documents(spark, f"{sf}/documents.parquet"), path, mode="overwrite")
    return S.read_text_corpus(spark, path).groupBy(F.md5("text").alias("text_md5")).agg(F.count("*").alias("n"))


@query("read_datasets", with_views("v_problems") + """
SELECT 'prompts' AS kind, count(*) AS n, CAST(sum(length(num1)) AS BIGINT) AS n_chars FROM v_problems
UNION ALL SELECT unnest(['documents', 'text']), count(*), CAST(sum(length(text)) AS BIGINT) FROM documents""")
def read_datasets(spark, sf):
    """Every registered type of data set, each read through the registry."""
    prompts, corpus = _folder(spark, "read_prompts"), _folder(spark, "read_text")
    S.write_problems(view(spark, sf, "v_problems").select("num1", "num2"), prompts, "test", "overwrite")
    S.write_text_corpus(S.read_documents(spark, f"{sf}/documents.parquet"), corpus, mode="overwrite")
    paths = {"prompts": (prompts, "num1"), "documents": (f"{sf}/documents.parquet", "text"), "text": (corpus, "text")}
    parts = [S.read_dataset(spark, kind, path).agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.sum(F.length(c)).alias("n_chars")) for kind, (path, c) in paths.items()]
    return reduce(DataFrame.unionByName, parts)


@query("count_label", """
WITH c AS (SELECT l_suppkey, count(*) * l_suppkey AS n FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, n, CASE WHEN n >= 1000000 THEN CAST(n // 1000000 AS VARCHAR) || 'M' WHEN n >= 1000 THEN CAST(n // 1000 AS VARCHAR) || 'k' ELSE CAST(n AS VARCHAR) END AS label FROM c""")
def count_label(spark, sf):
    t = table(spark, sf, "lineitem").groupBy("l_suppkey").agg((F.count("*") * F.first("l_suppkey")).alias("n"))
    return t.withColumn("label", S.count_label(F.col("n")))


def _md5_long(text):
    """The first 15 hexadecimal digits of the md5 sum as a long."""
    return F.conv(F.substr(F.md5(text), F.lit(1), F.lit(15)), 16, 10).cast("bigint")


def _fingerprint_sql(table_: str, id_: str, text: str, suffix: str) -> str:
    return f"""SELECT sha256(concat_ws('|', CAST(sum(CAST(h AS HUGEINT)) AS VARCHAR), CAST(bit_xor(h) AS VARCHAR), CAST(count(*) AS VARCHAR), 'single')) || '{suffix}' AS content_key,
  count(*) AS n, '{table_}' AS source FROM (SELECT CAST('0x' || substr(md5(concat(coalesce(CAST({id_} AS VARCHAR), '~'), '|', coalesce({text}, '~'))), 1, 15) AS BIGINT) AS h FROM {table_})"""


@query("content_fingerprint", _fingerprint_sql("documents", "doc_id", "text", "") + " UNION ALL " + _fingerprint_sql("pages", "page_id", "html", "_pos"))
def content_fingerprint(spark, sf):
    def key(name, id_, text, **more):
        row = F.concat(F.coalesce(F.col(id_).cast("string"), F.lit("~")), F.lit("|"), F.coalesce(text, F.lit("~")))
        return S.content_key(table(spark, sf, name), [id_, text], "single", hashed=_md5_long(row), **more).withColumn("source", F.lit(name))

    return key("documents", "doc_id", "text").unionByName(key("pages", "page_id", "html", negative=False))


@query("snapshot_long", with_views("v_rows") + " SELECT task, model, reasoning, count(*) AS n, round(sum(performance), 6) AS total FROM v_rows GROUP BY ALL")
def snapshot_long(spark, sf):
    t = view(spark, sf, "v_rows").select("task", "model", "reasoning", "performance")
    saved = S.snapshot_long(t, _folder(spark, "snapshot_long"), reuse=False)
    return saved.groupBy("task", "model", "reasoning").agg(F.count("*").alias("n"), F.round(F.sum("performance"), 6).alias("total"))


# ---- grids ----

_GRID_SQL = """
  e AS (SELECT unnest(range(-14, 15)) AS e), p AS (SELECT a.e AS exp1, b.e AS exp2 FROM e a CROSS JOIN e b),
  g AS (SELECT 'Addition' AS task, exp1, exp2 FROM p UNION ALL SELECT 'Multiplication', exp1, exp2 FROM p WHERE exp1 + exp2 + 2 > -14 AND exp1 + exp2 < 15
    UNION ALL SELECT 'Division', exp1, exp2 FROM p WHERE exp1 - exp2 >= -14 AND exp1 - exp2 < 15
    UNION ALL SELECT 'Exponentiation', e, NULL FROM e UNION ALL SELECT 'Mean', e, NULL FROM e WHERE e BETWEEN -12 AND 12)"""


def _grids(spark) -> DataFrame:
    tasks = ["Addition", "Multiplication", "Division", "Exponentiation", "Mean"]
    return reduce(DataFrame.unionByName, [G.exponent_grid(spark, t).withColumn("task", F.lit(t)) for t in tasks])


@query("exponent_grid", with_views("v_problems") + f""", {_GRID_SQL},
  c AS (SELECT num1_exp, num2_exp, count(*) AS n FROM v_problems GROUP BY ALL), s AS (SELECT num1_exp, sum(n) AS n FROM c GROUP BY ALL)
SELECT task, CAST(exp1 AS INT) AS exp1, CAST(exp2 AS INT) AS exp2, CAST(coalesce(CASE WHEN exp2 IS NULL THEN s.n ELSE c.n END, 0) AS BIGINT) AS n_problems
FROM g LEFT JOIN c ON c.num1_exp = exp1 AND c.num2_exp = exp2 LEFT JOIN s ON s.num1_exp = exp1""")
def exponent_grid(spark, sf):
    """Every allowed cell of five tasks with the number of given problems that fall in it."""
    c = view(spark, sf, "v_problems").groupBy(F.col("num1_exp").alias("exp1"), F.col("num2_exp").alias("exp2")).agg(F.count("*").alias("n"))
    both = c.unionByName(c.groupBy("exp1").agg(F.sum("n").alias("n")).withColumn("exp2", F.lit(None).cast("int")))
    g, b = _grids(spark), both.select(F.col("exp1").alias("a"), F.col("exp2").alias("b"), "n")
    j = g.join(b, (F.col("exp1") == F.col("a")) & F.col("exp2").eqNullSafe(F.col("b")), "left")
    return j.select("task", "exp1", "exp2", F.coalesce("n", F.lit(0)).alias("n_problems"))


@query("allocate_samples", f"""WITH {_GRID_SQL}, n AS (SELECT count(*) AS n FROM lineitem),
  w AS (SELECT *, exp(-0.15 * abs(exp1 - coalesce(exp2, 0))) AS w FROM g)
SELECT task, CAST(exp1 AS INT) AS exp1, CAST(exp2 AS INT) AS exp2, CAST(CASE WHEN task IN ('Addition', 'Exponentiation')
  THEN greatest(1, floor(n * w / sum(w) OVER (PARTITION BY task))) ELSE ceil(n / count(*) OVER (PARTITION BY task)) END AS BIGINT) AS k FROM w, n""")
def allocate_samples(spark, sf):
    n = table(spark, sf, "lineitem").agg(F.count("*")).scalar()
    tasks = ["Addition", "Multiplication", "Division", "Exponentiation", "Mean"]
    cells = lambda t: G.exponent_grid(spark, t).withColumn("_n", n)
    return reduce(DataFrame.unionByName, [G.allocate(cells(t), F.col("_n"), t).drop("_n").withColumn("task", F.lit(t)) for t in tasks])


@query("digit_plan", """
WITH u AS (SELECT (l_partkey * 37 % 1000) / 1000.0 AS u FROM lineitem), p AS (SELECT unnest(['full', 'uniform', 'triangular', 'exponential']) AS kind),
  d AS (SELECT kind, CAST(CASE kind WHEN 'full' THEN 53 WHEN 'uniform' THEN floor(2 + u * 52) WHEN 'triangular' THEN floor(2 + sqrt(u) * 51)
    ELSE floor(2 + ln(1 + u * (exp(0.06 * 51) - 1)) / 0.06) END AS INT) AS digits FROM u, p)
SELECT kind, digits, count(*) AS n FROM d GROUP BY ALL""")
def digit_plan(spark, sf):
    t = table(spark, sf, "lineitem").select(((F.col("l_partkey") * 37 % 1000) / 1000.0).alias("u"))
    kinds = ["full", "binary_uniform", "binary_triangular", "binary_exponential"]
    plans = F.array(*[F.struct(F.lit(k.split("_")[-1]).alias("kind"), G.digit_plan(F.col("u"), k, 2, 53).alias("digits")) for k in kinds])
    return t.select(F.inline(plans)).groupBy("kind", "digits").agg(F.count("*").alias("n"))


# ---- generators: a fresh problem for each order, in its cell ----

def _size(spark, sf) -> int:
    return table(spark, sf, "orders").count()


def _cells(spark, sf):
    """The orders of magnitude of each order's price and customer number, and a list of their size."""
    exp1 = F.floor(F.log10("o_totalprice")).cast("int")
    return table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", exp1.alias("exp1"), F.floor(F.log10(F.col("o_custkey") + 1)).cast("int").alias("exp2"),
        (F.col("o_custkey") % 4 + 2).alias("list_len"), (exp1 - F.col("o_orderkey") % 3).alias("spread"))


def _generator(name: str, task: str):
    @query(name)
    def run(spark, sf):
        return P.publish(P.to_prompts(G.generate(spark, task, split="test", like=_cells(spark, sf)), task), "train", verbose=True)
    return run


gen_addition = _generator("gen_addition", "Addition")
gen_multiplication = _generator("gen_multiplication", "Multiplication")
gen_divm = _generator("gen_divm", "DivM")
gen_division = _generator("gen_division", "Division")
gen_exponentiation = _generator("gen_exponentiation", "Exponentiation")
gen_mean = _generator("gen_mean", "Mean")
gen_std = _generator("gen_std", "Std")
gen_minmax = _generator("gen_minmax", "MinMax")
gen_sorting = _generator("gen_sorting", "Sorting")
gen_interval = _generator("gen_interval", "Interval")


@query("generate_until")
def generate_until(spark, sf):
    """Exactly as many distinct additions as there are orders, published with both difficulties."""
    return P.publish(P.to_prompts(G.generate_until(spark, "Addition", _size(spark, sf), "test"), "Addition"), "train")


# ---- statistics and subsets ----

@query("list_stats", with_views("v_lists") + f""",
  v AS (SELECT {KEY_SQL}, [CAST(a AS DOUBLE), CAST(b AS DOUBLE), CAST(c AS DOUBLE)] AS l, CAST(ref AS DOUBLE) AS ref FROM v_lists)
SELECT {KEY_SQL}, round(list_avg(l), 6) AS mean, round(list_stddev_pop(l), 4) AS std, list_min(l) AS minimum, list_max(l) AS maximum,
  list_sort(l)[2] AS middle, list_reverse_sort(l)[1] AS first_desc, CAST(len([x FOR x IN l IF x <= ref]) AS INT) AS position FROM v""")
def list_stats(spark, sf):
    t = view(spark, sf, "v_lists").withColumn("list1", F.array(*[F.col(c).cast("double") for c in "abc"])).withColumn("r", F.col("ref").cast("double"))
    t = G.list_statistics(t, "list1", "r")
    return t.select(*KEY, F.round("mean", 6).alias("mean"), F.round("std", 4).alias("std"), "minimum", "maximum", F.col("asc")[1].alias("middle"),
                    F.col("desc")[0].alias("first_desc"), "position")


@query("dedupe_problems", with_views("v_problems") + """
SELECT num1, num2, min(l_orderkey * 1000000 + l_partkey * 10 + l_linenumber) AS kept FROM (
  SELECT CAST(l_partkey AS VARCHAR) AS num1, num2, l_orderkey, l_partkey, l_linenumber FROM v_problems) GROUP BY num1, num2""")
def dedupe_problems(spark, sf):
    place = F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")
    t = view(spark, sf, "v_problems").withColumn("num1", F.col("l_partkey").cast("string")).withColumn("kept", place)
    return G.dedupe_problems(t, order=F.col("kept")).select("num1", "num2", "kept")


@query("exact_sample", f"""
WITH t AS (SELECT {KEY_SQL}, CAST(CAST('0x' || substr(md5(concat_ws('-', l_orderkey, l_linenumber, l_partkey)), 1, 16) AS UBIGINT) AS HUGEINT) AS u FROM lineitem),
  h AS (SELECT *, CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END AS h FROM t)
SELECT {KEY_SQL} FROM h ORDER BY h, {KEY_SQL} LIMIT 5000""")
def exact_sample(spark, sf):
    hashed = F.conv(F.substr(F.md5(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")), F.lit(1), F.lit(16)), 16, -10).cast("bigint")
    return G.exact_sample(table(spark, sf, "lineitem").select(*KEY), 5000, KEY, hashed=hashed)


@query("stratified_subset", """
WITH c AS (SELECT l_suppkey, l_linenumber, l_shipdate, count(*) AS n FROM (SELECT l_suppkey, l_linenumber, l_partkey % 40 AS l_shipdate FROM lineitem) GROUP BY ALL),
  t AS (SELECT sum(n) FILTER (n >= 2) AS valid, coalesce(sum(n) FILTER (n = 1), 0) AS single FROM c),
  s AS (SELECT *, least(single, greatest(floor(4000 * (1 - 4000 / valid)), 0)) AS singles FROM t),
  q AS (SELECT c.*, singles, floor(n * (4000 - singles) / valid) AS fl, round(n * (4000 - singles) / valid - floor(n * (4000 - singles) / valid), 9) AS rest FROM c, s WHERE n >= 2),
  r AS (SELECT *, row_number() OVER (ORDER BY rest DESC, l_suppkey, l_linenumber, l_shipdate) AS rk, 4000 - singles - sum(fl) OVER () AS short FROM q)
SELECT l_suppkey, l_linenumber, l_shipdate AS part_group, CAST(fl + CASE WHEN rk <= short THEN 1 ELSE 0 END AS BIGINT) AS n FROM r WHERE fl + CASE WHEN rk <= short THEN 1 ELSE 0 END > 0
UNION ALL SELECT NULL, NULL, NULL, CAST(singles AS BIGINT) FROM s WHERE singles > 0""")
def stratified_subset(spark, sf):
    strata = ["l_suppkey", "l_linenumber", "part_group"]
    t = table(spark, sf, "lineitem").select(*KEY, (F.col("l_partkey") % 40).alias("part_group"))
    sub = G.stratified_subset(t, 4000, strata)
    # single rows share one line, as which of them are drawn is up to the hash
    size = t.groupBy(*strata).agg(F.count("*").alias("size"))
    g = sub.groupBy(*strata).agg(F.count("*").alias("n")).join(size, strata)
    lone = F.col("size") == 1
    return g.groupBy(*[F.when(~lone, F.col(c)).alias(c) for c in strata]).agg(F.sum("n").alias("n"))


# ---- prompts ----

@query("prompts_arithmetic", with_views("v_problems") + f""",
  o AS (SELECT *, CASE l_linenumber % 4 WHEN 0 THEN operator WHEN 1 THEN '*' WHEN 2 THEN '/' ELSE '^' END AS op FROM v_problems)
SELECT {KEY_SQL}, num1 || ' ' || op || ' ' || num2 AS prompt, 'What is ' || num1 || ' ' || op || ' ' || num2 || '?' AS text_prompt,
  CASE l_linenumber % 4 WHEN 0 THEN total ELSE prod END AS answer FROM o""")
def prompts_arithmetic(spark, sf):
    t = view(spark, sf, "v_problems").withColumnRenamed("total", "sum").withColumn("quot", F.col("prod")).withColumn("exp", F.col("prod"))
    tasks = ["Addition", "Multiplication", "Division", "Exponentiation"]
    parts = [P.to_prompts(t.filter(F.col("l_linenumber") % 4 == i), task) for i, task in enumerate(tasks)]
    return reduce(DataFrame.unionByName, [p.select(*KEY, "prompt", "text_prompt", "answer") for p in parts])


@query("prompts_compare", with_views("v_problems") + f""",
  o AS (SELECT *, CASE WHEN l_partkey % 2 = 0 THEN '<' ELSE '>' END AS op FROM v_problems)
SELECT {KEY_SQL}, num1 || ' ' || op || ' ' || num2 AS prompt, 'Is ' || num1 || ' ' || CASE WHEN l_suppkey % 2 = 1 THEN op WHEN op = '<' THEN 'less than' ELSE 'greater than' END
  || ' ' || num2 || '?' AS text_prompt, CASE WHEN op = '<' THEN CAST(num1 AS DOUBLE) < CAST(num2 AS DOUBLE) ELSE CAST(num1 AS DOUBLE) > CAST(num2 AS DOUBLE) END AS answer FROM o""")
def prompts_compare(spark, sf):
    t = P.compare_prompts(view(spark, sf, "v_problems"), F.col("l_partkey") % 2 == 0, F.col("l_suppkey") % 2 == 0)
    return t.select(*KEY, "prompt", "text_prompt", "answer")


_SORTED = """
  s AS (SELECT *, list_transform(list_sort([{v: CAST(a AS DOUBLE), t: a}, {v: CAST(b AS DOUBLE), t: b}, {v: CAST(c AS DOUBLE), t: c}]), lambda x: x.t) AS asc_ FROM v_lists)"""


def _lists(spark, sf):
    t = view(spark, sf, "v_lists").withColumn("list1", F.array("a", "b", "c"))
    pairs = F.sort_array(F.transform("list1", lambda x: F.struct(x.cast("double").alias("v"), x.alias("t"))))
    t = t.withColumn("asc", F.transform(pairs, lambda p: p["t"])).withColumn("desc", F.reverse("asc"))
    return t.withColumn("minimum", F.col("asc")[0]).withColumn("maximum", F.col("desc")[0])


@query("prompts_minmax", with_views("v_lists") + f""",{_SORTED}
SELECT {KEY_SQL}, CASE WHEN l_partkey % 2 = 0 THEN '<|min|>' ELSE '<|max|>' END || a || ', ' || b || ', ' || c AS prompt,
  'What is the ' || CASE WHEN l_partkey % 2 = 0 THEN 'minimum' ELSE 'maximum' END || ' of the list [' || a || ', ' || b || ', ' || c || ']?' AS text_prompt,
  CASE WHEN l_partkey % 2 = 0 THEN asc_[1] ELSE asc_[3] END AS answer FROM s""")
def prompts_minmax(spark, sf):
    return P.minmax_prompts(_lists(spark, sf), F.col("l_partkey") % 2 == 0).select(*KEY, "prompt", "text_prompt", "answer")


@query("prompts_sort", with_views("v_lists") + f""",{_SORTED}
SELECT {KEY_SQL}, CASE WHEN l_partkey % 2 = 0 THEN '<|asc|>' ELSE '<|desc|>' END || a || ', ' || b || ', ' || c AS prompt,
  'Sort the list [' || a || ', ' || b || ', ' || c || '] in ' || CASE WHEN l_partkey % 2 = 0 THEN 'ascending' ELSE 'descending' END || ' order.' AS text_prompt,
  CASE WHEN l_partkey % 2 = 0 THEN array_to_string(asc_, ', ') ELSE array_to_string(list_reverse(asc_), ', ') END AS answer FROM s""")
def prompts_sort(spark, sf):
    return P.sort_prompts(_lists(spark, sf), F.col("l_partkey") % 2 == 0).select(*KEY, "prompt", "text_prompt", "answer")


@query("prompts_interval", with_views("v_lists") + f""",{_SORTED}
SELECT {KEY_SQL}, '<|intva|>' || ref || ': A ' || asc_[1] || ' B ' || asc_[2] || ' C ' || asc_[3] || ' D' AS prompt,
  'What interval does x=' || ref || ' belong to? A: x < ' || asc_[1] || ', B: ' || asc_[1] || ' <= x < ' || asc_[2] || ', C: ' || asc_[2] || ' <= x < ' || asc_[3] || ', D: ' || asc_[3] || ' <= x' AS text_prompt,
  substr('ABCD', 1 + len([x FOR x IN asc_ IF CAST(x AS DOUBLE) <= CAST(ref AS DOUBLE)]), 1) AS answer FROM s""")
def prompts_interval(spark, sf):
    t = _lists(spark, sf).withColumn("list1", F.col("asc"))
    t = t.withColumn("position", F.size(F.filter("list1", lambda x: x.cast("double") <= F.col("ref").cast("double"))))
    return P.interval_prompts(t).select(*KEY, "prompt", "text_prompt", "answer")


@query("prompts_list_stat", with_views("v_lists") + f"""
SELECT {KEY_SQL}, CASE WHEN l_partkey % 2 = 0 THEN '<|mean|>' ELSE '<|std|>' END || a || ', ' || b || ', ' || c AS prompt,
  'What is the ' || CASE WHEN l_partkey % 2 = 0 THEN 'mean' ELSE 'std' END || ' of the list [' || a || ', ' || b || ', ' || c || ']?' AS text_prompt,
  CASE WHEN l_partkey % 2 = 0 THEN a ELSE b END AS answer FROM v_lists""")
def prompts_list_stat(spark, sf):
    t = view(spark, sf, "v_lists").withColumn("list1", F.array("a", "b", "c")).withColumn("mean", F.col("a")).withColumn("std", F.col("b"))
    parts = [P.to_prompts(t.filter(F.col("l_partkey") % 2 == i), task) for i, task in enumerate(["Mean", "Std"])]
    return reduce(DataFrame.unionByName, [p.select(*KEY, "prompt", "text_prompt", "answer") for p in parts])


@query("prompts_repeat", with_views("v_problems") + f"""
SELECT {KEY_SQL}, CASE WHEN l_partkey % 2 = 0 THEN '<|repeat|>' || num1 ELSE '<|char|>' || (1 + l_suppkey % 2) || ' ' || num1 END AS prompt,
  CASE WHEN l_partkey % 2 = 0 THEN 'Repeat the number ' || num1 || '.' ELSE 'What is the ' || (1 + l_suppkey % 2) || '. digit of ' || num1 || '?' END AS text_prompt,
  CASE WHEN l_partkey % 2 = 0 THEN num1 ELSE substr(num1, CAST(1 + l_suppkey % 2 AS INT), 1) END AS answer FROM v_problems""")
def prompts_repeat(spark, sf):
    t = view(spark, sf, "v_problems").withColumn("digit_pos", (F.col("l_suppkey") % 2 + 1).cast("int"))
    t = t.withColumn("digit", F.substr("num1", F.col("digit_pos"), F.lit(1)))
    parts = [P.to_prompts(t.filter(F.col("l_partkey") % 2 == i), task) for i, task in enumerate(["Repeat", "Digit"])]
    return reduce(DataFrame.unionByName, [p.select(*KEY, "prompt", "text_prompt", "answer") for p in parts])


@query("publish_columns", with_views("v_problems") + """
SELECT num1 || ' ' || operator || ' ' || num2 AS prompt, 'What is ' || num1 || ' ' || operator || ' ' || num2 || '?' AS text_prompt, total AS answer,
  CAST(l_linenumber AS INT) AS difficulty, CAST(l_quantity AS INT) AS difficulty_sd FROM v_problems ORDER BY difficulty_sd""")
def publish_columns(spark, sf):
    t = view(spark, sf, "v_problems").withColumnRenamed("total", "sum").withColumn("difficulty", F.col("l_linenumber").cast("int"))
    t = t.withColumn("difficulty_sd", F.col("l_quantity").cast("int"))
    return P.publish(P.to_prompts(t, "Addition"), "test")


@query("split_leak_check", with_views("v_problems") + f"""
SELECT {KEY_SQL} FROM v_problems t WHERE l_suppkey % 10 > 1 AND NOT EXISTS (SELECT 1 FROM v_problems h WHERE h.l_suppkey % 10 <= 1 AND h.num1 = t.num1 AND h.num2 = t.num2)""")
def split_leak_check(spark, sf):
    t, split = view(spark, sf, "v_problems"), F.col("l_suppkey") % 10
    return G.split_leak_check(t.filter(split > 1), t.filter(split == 0), t.filter(split == 1), keys=["num1", "num2"]).select(*KEY)


@query("bounds_filter", with_views("v_lists") + f""",
  v AS (SELECT {KEY_SQL}, [CAST(a AS DOUBLE), CAST(b AS DOUBLE), CAST(c AS DOUBLE)] AS l FROM v_lists)
SELECT {KEY_SQL} FROM v WHERE len([x FOR x IN l IF x = 0 OR (abs(x) >= 1000 AND abs(x) < 90000)]) = 3 AND len(list_distinct(l)) = 3""")
def bounds_filter(spark, sf):
    t = view(spark, sf, "v_lists").withColumn("list1", F.array(*[F.col(c).cast("double") for c in "abc"]))
    return P.bounds_filter(t, "list1", 1000.0, 90000.0, distinct=True).select(*KEY)
