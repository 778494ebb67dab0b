"""Files, the stream, and what the plans look like."""
import re

import pytest
from pyspark.sql import functions as F

from tallyforge.plans import QUERIES
from tallyforge.plans.registry import table
from tallyforge.plans.views import view
from tallyforge.sources import files as S

SF = "/root/testdata/sf0.001"


def test_problem_files(spark, tmp_path):
    df = spark.createDataFrame([("1 + 1", "2", "x"), ('say "a, b"', "3", "y")], "prompt string, answer string, extra string")
    for split in ("test", "train"):
        path = str(tmp_path / split)
        S.write_problems(df, path, split)
        back = S.read_problems(spark, path, ["prompt", "answer"])
        assert sorted(map(tuple, back.collect())) == sorted((r.prompt, r.answer) for r in df.collect())
    with pytest.raises(ValueError):
        S.read_problems(spark, str(tmp_path / "test"), ["absent"])
    with pytest.raises(ValueError):
        S.read_problems(spark, "problems.json")
    assert S.problem_name("Addition", "decimal_uniform", "train", 30_000_000) == "Addition_decimal_uniform_train_30M"


def test_discover_results(spark, tmp_path):
    name = "Mean_decimal_uniform_test_10k_shuffle_openai__gpt-5_re_high.csv"
    (tmp_path / name).write_text("text_prompt,raw_response\np1,\"a\nb\"\np2,x\np3,y\n")
    (tmp_path / name.replace("Mean", "Std")).write_text("text_prompt,raw_response,usage.cost\nq,z,0.5\n")
    (tmp_path / "notes_re_x.csv").write_text("a,b\n1,2\n")
    both = S.discover_results(spark, str(tmp_path / "*.csv"))
    assert [(r.text_prompt, r["usage.cost"], r.row_idx) for r in both.filter("task = 'Std'").collect()] == [("q", "0.5", 0)]
    got = both.filter("task = 'Mean'").orderBy("row_idx").collect()
    assert [(r.row_idx, r.text_prompt, r.model, r.task, r.reasoning_effort) for r in got] == [(i, f"p{i + 1}", "openai/gpt-5", "Mean", "high") for i in range(3)]
    pairs = spark.createDataFrame([("a_gemini_H1.csv",), ("a_gemini_H2.csv",), ("b_gemini_H1.csv",), ("c_H1.csv",)], "file string")
    assert [tuple(r) for r in S.run_pairs(pairs).collect()] == [("a_gemini_H1.csv", "a_gemini_H2.csv", "a_gemini_high.csv")]


def test_row_index_in_split_files(spark, tmp_path):
    """Lines are numbered through all splits of a file, and on from file to file."""
    texts = [[f"{k}-{i}" + "x" * (i % 50) for i in range(n)] for k, n in enumerate((3000, 1, 700))]
    (tmp_path / "p").mkdir()
    for k, lines in enumerate(texts):
        (tmp_path / "p" / f"part-{k}.csv").write_text("prompt,answer\n" + "".join(f"{t},{k}\n" for t in lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        one = S.read_problems(spark, str(tmp_path / "p"), ["prompt"], row_idx=True)
        assert one.rdd.getNumPartitions() >= 4
        got = {(r.file.rsplit("/", 1)[1], r.row_idx): r.prompt for r in one.collect()}
        assert got == {(f"part-{k}.csv", i): t for k, lines in enumerate(texts) for i, t in enumerate(lines)}
        across = S.read_problems(spark, str(tmp_path / "p"), ["prompt"], row_idx=True, across=True)
        assert [r.prompt for r in across.orderBy("row_idx").collect()] == sum(texts, [])
        assert sorted(r.row_idx for r in across.filter("prompt like '2-%'").collect()) == list(range(3001, 3701))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    S.write_problems(spark.createDataFrame([(t, "1") for t in texts[2]], "prompt string, answer string").coalesce(1), str(tmp_path / "z"), "train")
    zipped = S.read_problems(spark, [str(tmp_path / "z"), str(tmp_path / "p")], ["prompt"], row_idx=True)
    assert [r.prompt for r in zipped.filter("file like '%.gz'").orderBy("row_idx").collect()] == texts[2]


def test_chunks_of_tokens(spark, tmp_path):
    """Chunks may come in any order and again; what a writer left without a line in the manifest is not read."""
    path = str(tmp_path / "tokens")
    chunk = lambda n, k: spark.createDataFrame([(s, i, [k, i]) for s in ("a", "b") for i in range(n if s == "a" else 1)], "source string, context_idx bigint, tokens array<int>")
    for number, df in ((0, chunk(3, 0)), (2, chunk(2, 2)), (1, chunk(9, 9)), (1, chunk(4, 1))):
        S.append_tokens(df, path, number)
    chunk(5, 7).write.parquet(f"{path}/data/chunk=3/version=lost")
    rows = S.read_tokens(spark, path).orderBy("source", "context_idx").collect()
    assert [(r.context_idx, r.tokens) for r in rows if r.source == "a"] == list(enumerate([[k, i] for k, n in ((0, 3), (1, 4), (2, 2)) for i in range(n)]))
    assert [(r.context_idx, r.tokens[0]) for r in rows if r.source == "b"] == [(0, 0), (1, 1), (2, 2)]
    at = {(r.chunk, r.source): (r.first_context, r.first_token, r.tokens) for r in S.token_manifest(spark, path).collect()}
    assert at[2, "a"] == (7, 14, 4) and at[1, "b"] == (1, 2, 2)


def test_read_dataset(spark, tmp_path):
    spark.range(3).selectExpr("string(id) as text").write.parquet(f"{tmp_path}/docs")
    assert sorted(r.text for r in S.read_dataset(spark, "documents", f"{tmp_path}/docs").collect()) == ["0", "1", "2"]
    with pytest.raises(ValueError, match="unknown type"):
        S.read_dataset(spark, "images", str(tmp_path))


def test_content_key(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "i int, t string")
    key = lambda df: S.content_key(df).first().content_key
    assert key(a) == key(a.repartition(3)) != key(a.distinct())
    assert S.content_key(a, negative=False).first().content_key.endswith("_pos")
    one, other = (spark.createDataFrame([r], "p string, q string") for r in (("x", None), (None, "x")))
    assert key(one) != key(other)


def test_append_and_snapshot(spark, tmp_path):
    log = spark.createDataFrame([(1, "m", 0.5)], "step int, name string, value double")
    for _ in range(2):
        S.append_metrics(log, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    first = S.snapshot_long(log, str(tmp_path / "snap"))
    again = S.snapshot_long(log.limit(0), str(tmp_path / "snap"), reuse=True)
    assert first.count() == again.count() == 1


def test_stream_equals_batch(spark, tmp_path):
    """Three runs over several files, with keys that repeat in one run and in later ones; a batch that runs again adds nothing."""
    from tallyforge.functions.answers import parse_answer, score_answers
    from tallyforge.operators.leaderboard import perf_by
    from tallyforge.plans.corpus_queries import answers_of_events
    from tallyforge.streaming import score_stream as stream

    events = table(spark, SF, "events")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for run in range(3):
        part = events.filter((F.col("event_id") % 3 == run) | (F.col("event_id") % 15 < 3 * run))
        part.repartition(3).write.mode("append").parquet(src)
        arriving = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(src)
        stream.score_stream(answers_of_events(arriving), out, ["event_id"]).awaitTermination()
    batch = {tuple(r)[:3]: round(r.mean_performance, 9) for r in perf_by(score_answers(parse_answer(answers_of_events(events)))).collect()}
    table_ = stream.leaderboard(spark, out)
    assert {(r.model, r.reasoning, r.task): round(r.mean_performance, 9) for r in table_.collect()} == batch
    assert stream.scored_rows(spark, out).count() == events.count() == table_.agg(F.sum("n_samples")).first()[0]
    last = stream._batches(spark, out)
    assert len(last) == 2 and spark.read.parquet(f"{out}/sums/batch={last[-1]}").count() == len(batch)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


NATIVE = ["perf_by_model_task", "extract_numbers", "difficulty_curve", "cumulative_mean", "merge_runs", "canonical_prefix", "upsert_results", "usage_overview",
          "pack_contexts", "mix_sources", "number_bits", "prompts_interval", "stratified_subset", "exact_sample", "invalid_json_report", "recent_performance"]


@pytest.mark.parametrize("name", NATIVE)
def test_no_products_and_no_stray_python(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text
    if name not in ("perf_by_model_task", "difficulty_curve"):
        assert "ArrowEvalPython" not in text


def test_scan_reads_only_what_is_needed(spark):
    t = view(spark, SF, "v_preds").filter("truth > 50000").select("pred")
    text = t._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_extendedprice), GreaterThan(l_extendedprice,50000.0)]" in text
    assert re.search(r"ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_extendedprice:double>", text)


@pytest.mark.parametrize("name", ["stratified_subset", "resume_worklist"])
def test_few_scans_and_exchanges(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert text.count("FileScan") <= 6 and len(re.findall(r"(?<!Broadcast)Exchange ", text)) <= 12
