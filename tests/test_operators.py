"""Operators on hand-made tables, against brute force, and for any partitioning."""
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyforge import constants as C
from tallyforge.operators import corpus as K
from tallyforge.operators import generate as G
from tallyforge.operators import leaderboard as L
from tallyforge.operators import mixture as M
from tallyforge.operators import prompts as P
from tallyforge.operators import results as R
from tallyforge.operators.prefix import ranked, ranked_by_hash


def rows(df):
    return [tuple(r) for r in df.collect()]


# ---- order without one big task ----

def test_ranks_with_a_hot_group(spark):
    rng = random.Random(1)
    data = [(i, "hot" if rng.random() < 0.4 else f"k{rng.randint(0, 20)}", rng.randint(0, 10**6)) for i in range(3000)]
    df = spark.createDataFrame(data, "i int, k string, v int")
    seen, want = {}, {}
    for i, k, v in sorted(data, key=lambda r: (r[2], r[0])):
        seen[k] = want[i] = seen.get(k, 0) + 1
        want[i] = seen[k]
    for parts in (1, 4, 64):
        got = {r.i: r.rn for r in ranked(df.repartition(parts), ["k"], "v", ties=["i"]).collect()}
        assert got == want
    assert sorted(r.rn for r in ranked_by_hash(df, [], F.xxhash64("i"), ["i"]).collect()) == list(range(1, 3001))


# ---- result sets ----

def test_merge_runs(spark):
    h1 = spark.createDataFrame([(0, "a", "10", "p"), (1, "", "65535", "q"), (2, None, "5", "r"), (3, " ", "7", "s")], "i int, raw_response string, tokens string, only1 string")
    h2 = spark.createDataFrame([(0, "b", "11", "x"), (1, " ", "65535", "y"), (2, "c", "6", "z"), (3, None, "8", "w")], "i int, raw_response string, tokens string, only2 string")
    merged, warned = R.merge_runs(h1, h2, ["i"])
    got = {r.i: (r.raw_response, r.tokens, r.only1, r.only2) for r in merged.collect()}
    assert got == {0: ("a", "10", "p", "x"), 1: (C.TOKEN_LIMIT_TEXT, "65535", "q", "y"), 2: ("c", "6", None, "z"), 3: (" ", "7", "s", "w")}
    assert rows(warned) == [(3, "7", "8")]
    with pytest.raises(Exception, match="row count mismatch"):
        R.merge_runs(h1, h2.filter("i < 3"), ["i"])[0].collect()


def test_canonical_prefix(spark):
    can = spark.createDataFrame([("t", p, f"a{p}", i) for i, p in enumerate("vwxyz")], "task string, text_prompt string, answer string, pos int")
    res = spark.createDataFrame([("t", "w", "A", 0), ("t", " v", "B", 1), ("t", "v", "C", 2), ("t", "y", "D", 3)], "task string, text_prompt string, answer string, row_idx int")
    got, report = R.canonical_prefix(res, can, ["task"])
    assert sorted((r.pos, r.answer) for r in got.collect()) == [(0, "B"), (1, "A")]
    r = report.first()
    assert (r.n_kept, r.duplicate_prompts, r.duplicate_rows, r.first_missing, r.n_cut, r.changed) == (2, 1, 1, 2, 3, True)
    same = spark.createDataFrame([("t", p, "a", i) for i, p in enumerate("vwxyz")], "task string, text_prompt string, answer string, row_idx int")
    assert R.canonical_prefix(same, can, ["task"])[1].first().changed is False
    copied, report = R.canonical_prefix(same, can, ["task"], copy=["answer"])
    assert report.first().changed is True and {r.answer for r in copied.collect()} == {f"a{p}" for p in "vwxyz"}


def brute_upsert(existing, updates):
    out = [dict(r) for r in existing]
    for u in updates:
        hit = next((r for r in out if r["p"] == u["p"] and u["p"] and not (r["r"] or "").strip() and not r.get("used")), None)
        if hit:
            hit.update(r=u["r"], used=True)
        else:
            out.append({**u, "used": True})
    return sorted((r["p"] or "", r["r"] or "") for r in out)


def test_upsert(spark):
    rng = random.Random(3)
    ex = [{"i": i, "p": rng.choice("abc"), "r": rng.choice(["", "x", None])} for i in range(40)]
    up = [{"i": i, "p": rng.choice(["a", "b", "c", "d", ""]), "r": f"u{i}"} for i in range(40)]
    schema = "row_idx int, text_prompt string, raw_response string"
    a = spark.createDataFrame([(r["i"], r["p"], r["r"]) for r in ex], schema)
    b = spark.createDataFrame([(r["i"], r["p"], r["r"]) for r in up], schema)
    got = sorted((r.text_prompt or "", r.raw_response or "") for r in R.upsert_results(a, b).collect())
    assert got == brute_upsert(ex, up)


def test_resume(spark):
    inp = spark.createDataFrame([(i, f"p{i}") for i in range(8)], "row_idx int, text_prompt string")
    res = spark.createDataFrame([("p0", "x"), ("p1", ""), ("p5", None), ("p2", "y")], "text_prompt string, raw_response string")
    assert [(r.row_idx, r.kind) for r in R.resume_worklist(inp, res).orderBy("kind", "row_idx").collect()] == [(3, "new"), (4, "new"), (6, "new"), (7, "new"), (1, "retry"), (5, "retry")]
    assert sorted(r.row_idx for r in R.resume_worklist(inp, res, 5).collect()) == [1, 3, 5]
    assert R.resume_worklist(inp, res, 2).count() == 0


def test_answer_mismatch_by_task(spark):
    t = spark.createDataFrame([("a", 0, "1"), ("a", 1, "2"), ("b", 0, "3"), ("b", 1, "4")], "task string, row_idx int, answer string")
    assert R.answer_mismatch(t, t, ["task"], 10).count() == 0
    changed = t.withColumn("answer", F.when(F.col("answer") == "4", "5").otherwise(F.col("answer")))
    assert [tuple(r) for r in R.answer_mismatch(changed, t, ["task"], 10).collect()] == [("b", 1, "1")]


def test_examples_of_a_small_task(spark):
    t = spark.createDataFrame([("Addition", 0, "p", "1")], "task string, row_idx int, text_prompt string, answer string")
    assert len(R.chat_requests(t, 2).first().messages) == 4


# ---- curves ----

def test_curve_edges(spark):
    data = [("m", "r", "t", float(x), x / 10) for x in range(11)]
    df = spark.createDataFrame(data, "model string, reasoning string, task string, difficulty_sd double, performance double")
    got = {r.bin: r.value for r in L.difficulty_curve(df, bins=10, smooth=5, keep_max=False).collect()}
    assert len(got) == 10 and 10 not in got
    assert abs(got[0] - (0.0 + 0.1 + 0.2) / 5) < 1e-12 and abs(got[5] - 0.5) < 1e-12
    kept = {r.bin: r.value for r in L.difficulty_curve(df, bins=10, smooth=1).collect()}
    assert abs(kept[9] - 0.95) < 1e-12
    few = L.difficulty_curve(df.filter("difficulty_sd < 4"), bins=3, smooth=5, keep_max=False)
    assert sorted(round(r.value, 6) for r in few.collect()) == [0.0, 0.1, 0.2]


def test_null_groups_stay(spark):
    df = spark.createDataFrame([("a", None, "t", 1.0, 2, 0.5), ("a", "x", "t", None, None, 0.5)], "model string, reasoning string, task string, cost double, tokens int, performance double")
    g = L.usage_overview(df)
    assert g.filter("level = 'model_reasoning'").count() == 2 and g.filter("level = 'model'").first().n_samples == 2


# ---- corpus ----

def test_pack_matches_brute_force(spark):
    rng = random.Random(2)
    docs = [(s, i, [rng.randint(0, 9) for _ in range(rng.choice([0, 1, 3, 40]))]) for s in (1, 2) for i in range(30)]
    df = spark.createDataFrame(docs, "source int, doc_id int, tokens array<int>").withColumn("n_tokens", F.size("tokens"))
    for offset in (0, 5):
        got = {(r.source, r.context_idx): r.tokens for r in K.pack_contexts(K.token_offsets(df, ["source"], "doc_id"), ["source"], ["tokens"], 16, offset).collect()}
        want = {}
        for s in (1, 2):
            flat = [t for q, _, ts in docs if q == s for t in ts][offset:]
            want.update({(s, i): flat[i * 16 : i * 16 + 16] for i in range(len(flat) // 16)})
        assert got == want


def test_positions_masks_and_boundaries(spark):
    df = spark.createDataFrame([([5, 0, 7, 8, 0, 9],), ([1, 1],)], "t array<int>")
    got = df.select(K.position_ids("t", 0).alias("p")).collect()
    assert [r.p for r in got] == [[0, 1, 0, 1, 2, 0], [0, 1]]
    b = df.select(K.pack_boundaries(K.position_ids("t", 0)).alias("b")).first().b
    assert b.cu_seq_lens == [0, 2, 5, 6] and b.max_seq_length == 3
    m = spark.createDataFrame([([1, 5, 2, 6, 3, 1, 7, 2, 8, 3],)], "t array<int>").select(K.label_mask("t", 1, 2).alias("m")).first().m
    assert m == [None, None, None, 6, 3, None, None, None, 8, 3]


def brute_tokens(text, vocabulary):
    out, i = [], 0
    while i < len(text):
        hit = next((text[i:j] for j in range(len(text), i, -1) if text[i:j] in vocabulary), None)
        if hit is None:
            out += [vocabulary[f"<0x{b:02X}>"] for b in text[i].encode()]
            i += 1
        else:
            out.append(vocabulary[hit])
            i += len(hit)
    return out


def test_tokenize_is_leftmost_longest(spark):
    vocabulary = K.number_vocabulary(spark, "triple", ["a", "ab", "abc", "b", "bcd", " ", "<", "\n"], byte_fallback=True)
    table = {r.token: r.token_id for r in vocabulary.collect()}
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "b", "c", "d", " ", "1", "0", "7", "<", "<|eoq|>", "\n", "z", "é", "漢"]) for _ in range(30)) for _ in range(60)] + ["", "1007"]
    got = K.tokenize(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), vocabulary).collect()
    for r in got:
        assert list(r.tokens) == brute_tokens(r.text, table)
    short = K.number_vocabulary(spark, "triple", ["a"])
    assert list(K.tokenize(spark.createDataFrame([("az",)], "text string"), short, unknown=7).first().tokens)[1:] == [7]
    with pytest.raises(Exception, match="no entry for 'z'"):
        K.tokenize(spark.createDataFrame([("az",)], "text string"), short).collect()
    t = K.tokenize_numbers(spark.createDataFrame([("a 12.5 b -3",)], "text string"), K.number_vocabulary(spark, "number", ["a", "b", " "])).first()
    assert list(t.token_numbers) == [0, 0, 12.5, 0, 0, 0, -3.0] or list(t.token_numbers) == [0, 0, 12.5, 0, 0, 0, -3]


def test_lookup(spark):
    ranges = spark.createDataFrame([(0, 10, 3), (10, 15, 4), (20, 30, 5)], "lo bigint, hi bigint, d int")
    df = spark.createDataFrame([(x,) for x in (-1, 0, 10, 15, 16, 30, 31)], "x bigint")
    got = {r.x: r.d2 for r in K.lookup_ranges(df, ranges, "x", "d", "d2").collect()}
    assert got == {-1: -1, 0: 3, 10: 4, 15: 4, 16: -1, 30: 5, 31: -1}


def test_lookup_over_many_slices(spark, monkeypatch):
    monkeypatch.setattr(K, "RANGES_PER_SLICE", 7)
    ranges = spark.range(1000).selectExpr("id * 10 as lo", "id * 10 + 4 as hi", "int(id) as d")
    got = K.lookup_ranges(spark.range(-3, 10_020).withColumnRenamed("id", "x"), ranges, "x", "d", "d2").collect()
    assert all(r.d2 == (r.x // 10 if 0 <= r.x < 10_000 and r.x % 10 <= 4 else -1) for r in got) and len(got) == 10_023


def test_positions_and_labels(spark):
    rng = random.Random(11)
    rows = [[rng.choice([1, 2, 3, 9, 9]) for _ in range(rng.randrange(30))] for _ in range(40)]
    df = spark.createDataFrame([(r,) for r in rows] + [(None,)], "t array<int>")
    for r in df.select("t", K.position_ids("t", 3).alias("p"), K.label_mask("t", 1, 2).alias("m")).collect():
        if r.t is None:
            assert r.p is None and r.m is None
            continue
        at, depth = 0, 0
        for t, p, m in zip(r.t, r.p, r.m, strict=True):
            depth += (t == 1) - (t == 2)
            assert p == at and m == (None if depth > 0 or t == 2 else t)
            at = 0 if t == 3 else at + 1


# ---- mixtures ----

def test_mix_keeps_shares_and_epochs(spark):
    df = spark.range(900).select(F.col("id"), F.when(F.col("id") < 600, "a").otherwise("b").alias("source"))
    m = M.mix_sources(df, {"a": 0.75, "b": 0.25}, 40, ["id"], total=2000)
    assert m.count() == 2000
    counts = {(r.batch, r.source): r["count"] for r in m.groupBy("batch", "source").count().collect()}
    assert all(abs(counts[(b, "a")] - 30) <= 1 for b in range(50))
    once = m.filter("source = 'a' AND epoch = 0")
    assert once.count() == once.select("id").distinct().count() == 600
    # without a total every source is drawn whole, and the others are repeated
    whole = M.mix_sources(df, {"a": 0.2, "b": 0.8}, 40, ["id"])
    assert whole.count() == 3000 and whole.select("id").distinct().count() == 900
    assert M.mix_sources(df, {"a": 0.2, "b": 0.8}, 40, ["id"], stop="first").count() == 375
    with pytest.raises(ValueError, match="without a weight"):
        M.mix_sources(df, {"a": 1.0}, 40, ["id"])


def brute_caps(weights, caps):
    fixed = [False] * len(weights)
    while True:
        room = 1 - sum(c for c, f in zip(caps, fixed) if f)
        mass = sum(w for w, f in zip(weights, fixed) if not f)
        x = [c if f else (w * room / mass if room > 0 else 0) for w, c, f in zip(weights, caps, fixed)]
        over = [not f and v > c for v, c, f in zip(x, caps, fixed)]
        if not any(over):
            return x
        fixed = [f or o for f, o in zip(fixed, over)]


def test_capped_weights(spark):
    rng = random.Random(8)
    for _ in range(5):
        w = [rng.random() for _ in range(6)]
        caps = [rng.uniform(0.15, 0.6) for _ in range(6)]
        df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(w, caps))], "i int, weight double, cap double")
        got = [r.capped for r in M.capped_weights(df).orderBy("i").collect()]
        assert all(abs(a - b) < 1e-9 for a, b in zip(got, brute_caps(w, caps)))


def test_frontier(spark):
    levels = spark.createDataFrame([("t", d) for d in (0, 1, 2, 4)], "task string, difficulty int")
    front = spark.createDataFrame([("t", 1)], "task string, frontier int")
    good = [("t", d, s, 0.95) for d in (0, 1) for s in range(3)]
    step = lambda h: M.frontier_advance(spark.createDataFrame(h, "task string, difficulty int, step int, acc double"), levels, front, 0.9, 2, 3, 0.25).first()
    assert step(good).new_frontier == 2
    assert step(good[:-1]).new_frontier == 2  # three evaluations of the task are enough
    assert step(good[1:3]).mastered is False
    assert step([*good[:-1], ("t", 1, 2, 0.1)]).mastered is False
    top = spark.createDataFrame([("t", 4)], "task string, frontier int")
    done = M.frontier_advance(spark.createDataFrame([("t", 4, s, 1.0) for s in range(3)], "task string, difficulty int, step int, acc double"), levels, top, 0.9, 1, 3).first()
    assert done.finished and done.new_frontier == 4
    # late in training the bar of an easy level sinks to 0, and a level without history passes it
    late = M.frontier_advance(spark.createDataFrame([("t", 1, s, 1.0) for s in range(3)], "task string, difficulty int, step int, acc double"), levels, front, 0.9, 2, 3, 0.25, progress=1.0).first()
    assert late.mastered and late.new_frontier == 2


# ---- generation ----

@pytest.mark.parametrize("task", ["Addition", "Multiplication", "Division"])
def test_generated_results_hold(spark, task):
    n = 600
    a = [tuple(r) for r in G.generate(spark, task, n, "test").orderBy("num1", "num2").collect()]
    df = G.generate(spark, task, n, "test")
    for r in df.collect():
        x, y = Decimal(r.num1), Decimal(r.num2)
        if task == "Addition":
            want, got = (x + y if r.operator == "+" else x - y), Decimal(r["sum"])
        elif task == "Multiplication":
            want, got = x * y, Decimal(r["prod"])
        else:
            want, got = x / y, Decimal(r["quot"])
        # results keep 15 digits; operands enter as doubles
        assert abs(want - got) <= abs(want) * Decimal("5.5e-15") + max(abs(x), abs(y)) * Decimal("3e-16") * (task == "Addition")
        if task != "Addition":
            assert Decimal("1e-15") <= abs(got) <= Decimal("1e15")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert a == [tuple(r) for r in G.generate(spark, task, n, "test").orderBy("num1", "num2").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("task,dist", [("Mean", "decimal_uniform"), ("MinMax", "binary_exponential"), ("Interval", "decimal_uniform"), ("Sorting", "binary_triangular")])
def test_generated_lists_hold(spark, task, dist):
    st = G.Settings(distribution=dist)
    got = G.generate(spark, task, 25, "test", st).collect()
    assert len(got) > 200
    for r in got:
        values = [float(v) for v in r.list1]
        assert len(values) == r.list_len and all(v == 0 or 1e-14 <= abs(v) < 1e15 for v in values)
        if task == "Mean":
            assert abs(sum(values) / len(values) - float(r["mean"])) <= 1e-13 * max(map(abs, values))
        if task == "MinMax":
            assert float(r.minimum) == min(values) and float(r.maximum) == max(values)
        if task == "Sorting":
            assert [float(v) for v in r.asc] == sorted(values) and list(r.desc) == list(r.asc)[::-1]
        if task == "Interval":
            assert values == sorted(values) and r.position == sum(v <= float(r.ref) for v in values)


def test_generate_until_is_exact(spark):
    df = G.generate_until(spark, "Exponentiation", 700, "test")
    assert df.count() == 700 and df.select("num1", "num2").distinct().count() == 700


def test_exact_sample_and_subset(spark):
    df = spark.range(5000).select("id", (F.col("id") % 7).alias("a"), F.when(F.col("id") < 5, F.col("id") + 100).otherwise(0).alias("b"))
    s = G.exact_sample(df, 321, ["id"])
    assert s.count() == 321 == s.distinct().count()
    assert sorted(rows(s)) == sorted(rows(G.exact_sample(df.repartition(17), 321, ["id"])))
    sub = G.stratified_subset(df, 500, ["a", "b"])
    assert sub.count() == 500 == sub.select("id").distinct().count()


def test_prompts(spark):
    df = spark.createDataFrame([(["1.5", "3", "9"], "4", 2)], "list1 array<string>, ref string, position int")
    r = P.interval_prompts(df).first()
    assert r.prompt == "<|intva|>4: A 1.5 B 3 C 9 D" and r.answer == "C"
    assert r.text_prompt == "What interval does x=4 belong to? A: x < 1.5, B: 1.5 <= x < 3, C: 3 <= x < 9, D: 9 <= x"
    with pytest.raises(ValueError):
        P.to_prompts(df, "Unknown")


def test_exact_quantiles_and_moments(spark):
    """Continuous values of both signs, ties, infinities, one value, null keys; and a small deviation of large values."""
    import numpy as np

    rng = np.random.default_rng(6)
    groups = {"a": rng.normal(0, 1e-3, 4000), "b": np.repeat([1.0, 2.0, 5e-324, -0.0], [5, 1, 2, 4]), "c": [7.5], None: np.append(rng.normal(0, 1e200, 301), [np.inf, -np.inf]), "d": 1e9 + rng.normal(0, 1e-3, 5000)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("e", None)], "g string, v double").repartition(7)
    got = {r.g: r for r in L.describe(df, "v", ["g"]).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        want = np.percentile(vs, [25, 50, 75])
        assert [got[g].q25, got[g].q50, got[g].q75] == pytest.approx(list(want), rel=1e-12)
        assert (got[g].count_ if hasattr(got[g], "count_") else got[g]["count"]) == len(vs) and (got[g].min, got[g].max) == (min(vs), max(vs))
    assert got["d"].std == pytest.approx(np.std(groups["d"], ddof=1), rel=1e-4) and got["a"].std == pytest.approx(np.std(groups["a"], ddof=1), rel=1e-9) and got["c"].std is None
    whole = L.describe(df.filter("g = 'a'"), "v").first()
    assert [whole.q25, whole.q75] == pytest.approx(list(np.percentile(groups["a"], [25, 75])), rel=1e-12)
    plan = L.describe(df, "v", ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "collect_" not in plan


def test_level_contexts(spark):
    from tallyforge.operators import mixture as X

    rows = [("t", 0, 0, 1000), ("t", 1, 1000, 1010), ("t", 2, 1010, 1500), ("t", 3, 1500, 1530), ("u", 5, 0, 30), ("v", 1, 0, 40), ("v", 2, 40, 900)]
    got = {(r.task, r.difficulty): (r.first, r.last, r.borrowed) for r in X.level_contexts(spark.createDataFrame(rows, "task string, difficulty int, lo bigint, hi bigint"), 100).collect()}
    assert got == {
        ("t", 0): (0, 9, False), ("t", 1): (10, 11, True), ("t", 2): (11, 14, False), ("t", 3): (14, 15, True), ("u", 5): (0, 0, True), ("v", 1): (0, 1, True), ("v", 2): (1, 8, False)}
    contexts = X.contexts_of_levels(X.level_contexts(spark.createDataFrame(rows, "task string, difficulty int, lo bigint, hi bigint"), 100)).collect()
    assert sum(r.difficulty == 1 and r.task == "t" for r in contexts) == 1 and not [r for r in contexts if r.task == "u"]


@pytest.mark.parametrize("task", ["Addition", "Division", "Mean", "Interval"])
def test_problems_like_given_rows(spark, task):
    """One problem for each row, in the row's cell; the same whatever the partitions, and none outside the task's cells."""
    rows = [(i, i % 4, i % 3 - 1, 2 + i % 4, i % 4 - i % 2) for i in range(60)] + [(99, 400, 0, 3, 400), (100, 2, 1, 9, 2)]
    like = spark.createDataFrame(rows, "k int, exp1 int, exp2 int, list_len int, spread int")
    if task in C.LIST_TASKS:
        got = G.generate(spark, task, split="test", like=like.repartition(5)).collect()
        assert sorted((r.exp, r.list_len) for r in got) == sorted((r[1], r[3]) for r in rows[:60])
        assert all(len(r.list1) == r.list_len for r in got)
    else:
        made = [G.generate(spark, task, split="test", like=like.repartition(n)).select("num1", "num2").collect() for n in (1, 7)]
        assert sorted(map(tuple, made[0])) == sorted(map(tuple, made[1]))
        assert len(made[0]) == 61 and len({r.num1 for r in made[0]}) > 30
