"""What keeps queries even at scale: plans without costly steps, slices of bounded size, the methods that are named."""
import random

import pandas as pd
from pyspark.sql import functions as F

import corpus_pipeline
from tallyforge.functions import answers as A
from tallyforge.functions import difficulty as D
from tallyforge.functions import encode as E
from tallyforge.llm import simhash
from tallyforge.operators import corpus as K
from tallyforge.plans import problem_queries
from tallyforge.plans.leaderboard_queries import schema_violations
from tallyforge.sources import files as S

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


def test_difficulty_compares_texts_and_not_arrays_of_characters(spark):
    df = spark.createDataFrame([(["1.25", "1.5", None],), (["-12.5", "-13"],), (["7"],), (None,), (["10", "10", "102"],)], "a array<string>")
    out = df.select(D.difficulty_sort(F.col("a")).alias("s"), D.difficulty_mean(F.col("a")).alias("m"))
    assert [r.s for r in out.collect()] == [0, 2, 0, 0, 3]
    for c in (D.difficulty_sort(F.col("a")), D.difficulty_mean(F.col("a"))):
        assert "zip_with" not in plan(df.select(c)).lower() and "zipwith" not in plan(df.select(c)).lower()


def test_flip_mask_draws_all_places_at_once(spark):
    import hashlib

    df = spark.createDataFrame([(f"k{i}",) for i in range(50)], "k string")
    for share in (0.0, 0.01, 0.3):
        limit = f"{int(round(share * 65536)):04x}"
        for r in df.select("k", E.flip_mask("k", share).alias("m")).collect():
            h = "".join(hashlib.md5(f"42:{r.k}:{i}".encode()).hexdigest() for i in range(8))
            assert r.m == "".join("1" if h[4 * j : 4 * j + 4] < limit else "0" for j in range(64))
    back = E.roundtrip("x", "bits", 0.3, 42, F.col("k"), bernoulli=0.02)
    text = plan(df.withColumn("x", F.lit(1.5) * F.length("k")).select(back.alias("b"))).split("== Physical Plan ==")[-1]
    assert "lambda" not in text and text.count("md5") == 8


def test_bit_profile_groups_texts_before_the_wide_sums(spark):
    df = spark.createDataFrame([(1, "10"), (1, "10"), (1, "01"), (1, None), (2, None)], "s int, b string")
    out = E.bit_profile(df, "b", ["s"], width=2)
    got = sorted((r.s, r.place, r.share, r.n_distinct) for r in out.collect())
    assert got == [(1, 1, 2 / 3, 2), (1, 2, 1 / 3, 2), (2, 1, None, 0), (2, 2, None, 0)]
    assert "avg(" not in plan(out)


def test_schema_check_parses_a_text_once_and_sorts_nothing(spark):
    schema = {"type": "object", "properties": {"answer": {"type": "number"}}, "required": ["answer"], "additionalProperties": False}
    df = spark.createDataFrame([("I cannot",), ('{"answer": 1}',), ("[1]",), ("Sure",), (' {"answer": 1, "b": 2}',), ("-",)], "t string")
    found = df.select(A.schema_violation("t", schema).alias("v"))
    assert [r.v for r in found.collect()] == ["not_json", None, "not_object", "not_json", "extra_field", "not_json"]
    assert plan(found).split("== Physical Plan ==")[-1].count("parseJson") == 1
    assert "SortAggregate" not in plan(schema_violations(spark, SF))


def test_number_tokens_are_not_lowered(spark):
    df = spark.createDataFrame([("1.50",), ("1E5",), ("1e5",), ("-.5",)], "t string")
    out = df.select(A.token_float_text(F.col("t")).alias("x"))
    assert [r.x for r in out.collect()] == ["1.5", "100000.0", "100000.0", "-0.5"] and "lower(" not in plan(out)


def test_tokens_go_back_a_few_texts_at_a_time(spark, monkeypatch):
    texts = ["a b 1.5 -2", "", None, "ab " * 40, "é 7"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    vocabulary = K.number_vocabulary(spark, "number", ["a", "b", " ", "ab"], byte_fallback=True)
    tokens = lambda: [(r.id, r.tokens, r.token_numbers) for r in K.tokenize_numbers(df, vocabulary).orderBy("id").collect()]
    whole = tokens()
    monkeypatch.setattr(K, "TOKENIZED", 3)
    assert tokens() == whole and whole[2][1:] == (None, None) and [x for x in whole[0][2] if x] == [1.5, -2.0]


def test_near_duplicates_of_the_pipeline_are_simhash_components(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for k in range(60):
        base = [rng.choice(words) for _ in range(400)]
        for j in range(3):
            changed = list(base)
            for _ in range(2 * j):
                changed[rng.randrange(400)] = rng.choice(words)
            rows.append((1000 - 5 * k - j, " ".join(changed)))
    rows += [(None, "a text without an id"), (None, rows[0][1]), (3, "twice"), (3, "twice"), (3, "other"), (2, ""), (1, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, df, SF).collect()
    groups = simhash.near_duplicates(df).select("fingerprint", "component_id").toPandas()
    want = set(groups["component_id"].dropna().astype(int))
    assert {r.doc_id for r in kept if r.doc_id is not None} == want
    assert [r.text for r in kept if r.doc_id is None] == ["a text without an id"]
    assert len(kept) == len({(r.doc_id, r.text) for r in kept}) and sum(r.doc_id == 3 for r in kept) == 2


def test_files_of_problem_lines_grow_in_number(spark, monkeypatch):
    monkeypatch.setattr(problem_queries, "LINES", 500)
    want = problem_queries.view(spark, SF, "v_problems").orderBy(*problem_queries._LINE.split(", ")).select("num1", "operator", "num2", "total").collect()
    out = problem_queries.problem_lines(spark, SF)
    assert len(out.inputFiles()) >= len(want) // 500
    assert [tuple(r)[:4] for r in out.orderBy("row_idx").collect()] == [tuple(r) for r in want]


def test_result_files_are_written_in_slices(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "SLICE", 40)
    rows = [("Mean" if i % 3 else "Std", "a__b", "low", i * 37 % 301, f'"{i}"\nx') for i in range(301)] + [(None, "m", "low", 1, "lost")]
    df = spark.createDataFrame(rows, "task string, model string, reasoning string, i int, answer string")
    assert S.write_result_files(df, str(tmp_path), ["i"], ["answer"]) == 2
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == [f"{t}{S.RESULT_PATTERN}a__b_re_low.csv" for t in ("Mean", "Std")]
    for t in ("Mean", "Std"):
        got = pd.read_csv(tmp_path / f"{t}{S.RESULT_PATTERN}a__b_re_low.csv")["answer"].tolist()
        assert got == [a for _, _, a in sorted((r[3], r[0], r[4]) for r in rows if r[0] == t)]


def test_difficulty_of_additions_takes_one_lambda_call_a_place(spark):
    df = spark.createDataFrame([("12.5", "7", "19.5"), ("-3", "100", "97"), ("0", "0", "0"), ("999", "1", "1000"), ("5", None, "5")], "a string, b string, c string")
    out = df.select(D.difficulty_add(["a", "b"], "c").alias("d"))
    assert [r.d for r in out.collect()] == [1 + 3, 2 + 3, 0, 3 + 3, None]
    assert "filter(" not in plan(out).split("== Physical Plan ==")[-1]
