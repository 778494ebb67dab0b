"""Queries on model answers: parsing, scoring, leaderboards, curves, result-set upkeep."""
from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge import constants as C
from tallyforge.functions import answers as A
from tallyforge.functions import metrics as M
from tallyforge.operators import leaderboard as L
from tallyforge.operators import results as R
from tallyforge.operators.prefix import ranked
from tallyforge.plans.number_queries import KEY, KEY_SQL, sql_log_smape
from tallyforge.plans.registry import query, table
from tallyforge.plans.views import view, with_views
from tallyforge.session import materialized

REG = "(" + ", ".join(f"'{t}'" for t in C.REGRESSION_TASKS) + ")"
NUM = C.ANSWER_NUMBER


def sql_float_text(t: str) -> str:
    """Text of a plain decimal as a double prints it: no trailing zeros, but always a point."""
    return f"CASE WHEN contains({t}, '.') THEN regexp_replace(regexp_replace({t}, '0+$', ''), '[.]$', '.0') ELSE {t} || '.0' END"


# answers of v_results: every braced response has one plain {"answer": ...} object
PARSED = f"""
  cut AS (SELECT *, CASE WHEN contains(raw_response, '{{') THEN regexp_extract(raw_response, '\\{{"answer": (.*)\\}}', 1) END AS j,
    regexp_extract(raw_response, '({NUM})', 1) AS n FROM v_results),
  parsed AS (SELECT *, CASE WHEN raw_response IS NULL THEN ''
    WHEN j IS NOT NULL THEN CASE task WHEN 'Interval' THEN trim(j, '"') WHEN 'Sorting' THEN '[''' || replace(trim(j, '[]'), ', ', ''', ''') || ''']'
      WHEN 'MinMax' THEN j ELSE {sql_float_text('j')} END
    WHEN n <> '' THEN {sql_float_text('n')}
    WHEN task = 'Interval' THEN upper(regexp_extract(raw_response, '(?i)(?:^|[^A-Z])([A-F])(?:$|[^A-Z])', 1))
    ELSE '' END AS parsed_answer FROM cut)"""

SCORED = PARSED + f""",
  scored AS (SELECT *, CASE
      WHEN task IN {REG} THEN CASE WHEN parsed_answer = '' THEN 0.0 ELSE {sql_log_smape('CAST(parsed_answer AS DOUBLE)', 'CAST(answer AS DOUBLE)')} END
      WHEN task = 'Interval' THEN CASE WHEN upper(parsed_answer) = answer THEN 1.0 ELSE 0.0 END
      WHEN task = 'Sorting' THEN CASE WHEN [CAST(x AS DOUBLE) FOR x IN regexp_extract_all(parsed_answer, '{NUM}')]
        = [CAST(x AS DOUBLE) FOR x IN regexp_extract_all(answer, '{NUM}')] THEN 1.0 ELSE 0.0 END
      WHEN task = 'MinMax' THEN CASE WHEN parsed_answer = answer THEN 1.0 ELSE 0.0 END END AS performance,
    CASE WHEN task IN {REG} AND TRY_CAST(parsed_answer AS DECIMAL(18,4)) = CAST(answer AS DECIMAL(18,4)) THEN 1 ELSE 0 END AS exact15
    FROM parsed)"""

KEPT = """
  kept AS (SELECT * REPLACE (coalesce(tokens, -1) AS tokens) FROM scored WHERE model NOT LIKE '%gpt-4.1%' AND model <> 'x-ai__grok-4-fast_free'
    AND NOT (model = 'openai__gpt-oss-120b' AND reasoning = 'low')),
  ruled AS (SELECT * REPLACE (CASE WHEN model LIKE '%gemini-2.5-flash%' AND reasoning = 'none' AND tokens > 200 THEN NULL ELSE tokens END AS tokens,
    CASE WHEN reasoning = 'high' THEN 'maximal' ELSE reasoning END AS reasoning) FROM kept)"""

RULED = with_views("v_results") + "," + SCORED + "," + KEPT


def scored(spark, sf):
    """Every answer parsed and scored in one pass over the lines, without a shuffle."""
    return A.score_answers(A.parse_answer(view(spark, sf, "v_results")))


def ruled(spark, sf):
    return L.apply_rules(scored(spark, sf))


# ---- answers ----

@query("parse_answer", with_views("v_results") + f",{PARSED} SELECT {KEY_SQL}, task, parsed_answer, CASE WHEN raw_response IS NULL THEN "
       "'non_string_response' WHEN parsed_answer = '' THEN 'unparseable' ELSE '' END AS reason FROM parsed")
def parse_answer(spark, sf):
    return A.parse_answer(view(spark, sf, "v_results")).select(*KEY, "task", "parsed_answer", "reason")


@query("score_answers", with_views("v_results") + f",{SCORED} SELECT {KEY_SQL}, task, CAST(round(performance, 9) AS DOUBLE) AS performance FROM scored")
def score_answers(spark, sf):
    return scored(spark, sf).select(*KEY, "task", F.round("performance", 9).alias("performance"))


@query("exact15", with_views("v_results") + f",{SCORED} SELECT {KEY_SQL}, task, exact15 FROM scored")
def exact15(spark, sf):
    return scored(spark, sf).select(*KEY, "task", "exact15")


@query("clean_response", with_views("v_results") + f"""
SELECT {KEY_SQL}, trim(replace(coalesce(raw_response, ''), chr(10), ' ')) AS single_line,
  trim(regexp_replace(regexp_replace(trim(regexp_replace(raw_response, '^(?:JSON|Json|json)\\s*[:-]?\\s*', '')), '(?i)```(?:json|python|txt)?\\s*', '', 'g'),
  '^\\s+|\\s+$', '', 'g')) AS cleaned FROM v_results""")
def clean_response(spark, sf):
    t = view(spark, sf, "v_results")
    return t.select(*KEY, A.single_line("raw_response").alias("single_line"), A.clean_response("raw_response").alias("cleaned"))


@query("usage_tokens", """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_custkey WHEN 1 THEN 7 WHEN 2 THEN CAST(floor(o_totalprice) AS BIGINT) WHEN 3 THEN o_custkey + 1
  ELSE -1 END AS tokens, CASE o_orderkey % 5 WHEN 3 THEN CAST(o_custkey + 1 AS VARCHAR) END AS nested FROM orders""")
def usage_tokens(spark, sf):
    usage = F.expr("""CASE o_orderkey % 5
      WHEN 0 THEN concat('{"reasoning_tokens": ', o_custkey, ', "completion_tokens": 5}') WHEN 1 THEN '{"completion_tokens": 7, "total_tokens": 9}'
      WHEN 2 THEN concat('{"total_tokens": ', CAST(o_totalprice AS DECIMAL(12,2)), '}')
      WHEN 3 THEN concat('{"cost": 1, "completion_tokens_details": {"reasoning_tokens": ', o_custkey + 1, '}}') ELSE '{"cost": 2}' END""")
    t = table(spark, sf, "orders").select("o_orderkey", usage.alias("usage"))
    nested = F.try_element_at(A.usage_flat("usage"), F.lit("completion_tokens_details.reasoning_tokens"))
    return t.select("o_orderkey", A.usage_tokens("usage").alias("tokens"), nested.alias("nested"))


@query("tool_mentions", with_views("v_results") + f""",{SCORED}
SELECT {KEY_SQL}, model, task, answer, parsed_answer, thoughts, CASE WHEN task IN {REG} THEN CAST(round(performance, 9) AS DOUBLE) END AS log_smape,
  CASE WHEN task NOT IN {REG} THEN performance >= 0.999999 END AS correct
FROM scored WHERE regexp_matches(thoughts, '(?i)\\b(calculator|python|wolfram\\s*alpha|tool)\\b')""")
def tool_mentions(spark, sf):
    rows = A.tool_mentions(scored(spark, sf), "thoughts")
    return rows.select(*KEY, "model", "task", "answer", "parsed_answer", "thoughts", F.round("logSMAPE", 9).alias("log_smape"), "correct")


@query("invalid_json_report", with_views("v_results") + """,
  s AS (SELECT task, model, reasoning, CASE WHEN raw_response LIKE '{%}' THEN 0 ELSE 1 END AS bad FROM v_results),
  g AS (SELECT GROUPING(reasoning) AS coarse, task, model, reasoning, count(*) AS n_rows, CAST(sum(bad) AS BIGINT) AS n_invalid FROM s
    GROUP BY GROUPING SETS ((task, model, reasoning), (task, model)))
SELECT CASE WHEN coarse = 1 THEN 'task_model' ELSE 'task_model_reasoning' END AS level, task, model, reasoning, n_rows, n_invalid,
  round(n_invalid / n_rows, 9) AS frac_invalid FROM g WHERE n_invalid > 0""")
def invalid_json_report(spark, sf):
    g = L.invalid_json_report(view(spark, sf, "v_results"))
    return g.withColumn("frac_invalid", F.round("frac_invalid", 9))


@query("invalid_json_rows", with_views("v_results") + f"""
SELECT {KEY_SQL}, model, task, reasoning, raw_response FROM v_results WHERE raw_response IS NULL OR raw_response NOT LIKE '{{%}}'""")
def invalid_json_rows(spark, sf):
    return L.invalid_json_rows(view(spark, sf, "v_results")).select(*KEY, "model", "task", "reasoning", "raw_response")


# ---- leaderboard ----

@query("exclude_models", with_views("v_results") + """
SELECT model, reasoning, count(*) AS n FROM v_results WHERE model NOT LIKE '%gpt-4.1%' AND model <> 'x-ai__grok-4-fast_free'
  AND NOT (model = 'openai__gpt-oss-120b' AND reasoning = 'low') GROUP BY model, reasoning""")
def exclude_models(spark, sf):
    return L.exclude_models(view(spark, sf, "v_results")).groupBy("model", "reasoning").agg(F.count("*").alias("n"))


@query("leaderboard_rules", RULED + " SELECT model, reasoning, count(*) AS n, count(tokens) AS n_tokens, CAST(sum(tokens) AS BIGINT) AS sum_tokens "
       "FROM ruled GROUP BY model, reasoning")
def leaderboard_rules(spark, sf):
    t = L.apply_rules(view(spark, sf, "v_results"))
    return t.groupBy("model", "reasoning").agg(F.count("*").alias("n"), F.count("tokens").alias("n_tokens"), F.sum("tokens").alias("sum_tokens"))


_CANON = """CASE WHEN m LIKE '%deepseek%' THEN 1 WHEN m LIKE '%gemini-2.5-flash%' THEN 2 WHEN m LIKE '%gemini-2.5-pro%' THEN 3
  WHEN m LIKE '%llama-4%' THEN 4 WHEN m LIKE '%kimi%' THEN 5 WHEN m LIKE '%gpt-4.1%' THEN 6 WHEN m LIKE '%gpt-5%' THEN 7
  WHEN m LIKE '%gpt-oss%' OR m LIKE '%oss-120b%' THEN 8 WHEN m LIKE '%qwen3%' OR m LIKE '%qwen/%' THEN 9 ELSE 0 END"""
_KEYS = "[" + ", ".join(f"'{r[1]}'" for r in C.MODEL_RULES) + "]"
_NAMES = "[" + ", ".join(f"'{r[2]}'" for r in C.MODEL_RULES) + "]"


def sql_canonical(source: str) -> str:
    return f"""named AS (SELECT *, CASE WHEN c = 0 THEN m ELSE {_KEYS}[c] END AS canonical, CASE WHEN c = 0 THEN replace(model, '__', '/') ELSE {_NAMES}[c] END AS display
  FROM (SELECT *, {_CANON} AS c FROM (SELECT *, lower(replace(model, '__', '/')) AS m FROM {source})))"""


@query("canonical_model", with_views("v_results") + f", {sql_canonical('v_results')} SELECT model, canonical, display, count(*) AS n FROM named GROUP BY ALL")
def canonical_model(spark, sf):
    t = view(spark, sf, "v_results").groupBy("model").agg(F.count("*").alias("n"))
    return t.select("model", L.canonical_model(F.col("model")).alias("canonical"), L.display_model(F.col("model")).alias("display"), "n")


@query("perf_by_model_task", RULED + " SELECT model, reasoning, task, CAST(round(avg(performance), 6) AS DOUBLE) AS mean_performance FROM ruled GROUP BY model, reasoning, task")
def perf_by_model_task(spark, sf):
    return L.perf_by(ruled(spark, sf)).withColumn("mean_performance", F.round("mean_performance", 6))


@query("tokens_perf", RULED + """ SELECT task, model, reasoning, round(avg(tokens), 6) AS avg_tokens, CAST(round(avg(performance), 6) AS DOUBLE) AS avg_perf
  FROM ruled GROUP BY task, model, reasoning""")
def tokens_perf(spark, sf):
    return L.tokens_perf(ruled(spark, sf)).withColumn("avg_tokens", F.round("avg_tokens", 6)).withColumn("avg_perf", F.round("avg_perf", 6))


@query("tokens_vs_perf", with_views("v_results") + "," + SCORED + "," + KEPT.replace("kept AS (", "kept0 AS (").replace("FROM kept)", "FROM kept)").replace(
    "ruled AS (", "kept AS (SELECT * FROM kept0 WHERE tokens <> 65535 AND tokens >= 0), ruled AS (") + """,
  t AS (SELECT task, model, reasoning, avg(tokens) AS avg_tokens FROM ruled GROUP BY ALL),
  p AS (SELECT task, model, reasoning, avg(performance) AS avg_perf FROM ruled GROUP BY ALL)
SELECT task, model, reasoning, round(avg_tokens, 6) AS avg_tokens, CAST(round(avg_perf, 6) AS DOUBLE) AS avg_perf FROM t FULL JOIN p USING (task, model, reasoning)""")
def tokens_vs_perf(spark, sf):
    t = L.tokens_vs_perf(scored(spark, sf))
    return t.withColumn("avg_tokens", F.round("avg_tokens", 6)).withColumn("avg_perf", F.round("avg_perf", 6))


@query("exact15_by_task", RULED + f" SELECT model, reasoning, task, round(avg(exact15), 6) AS exact15_acc FROM ruled WHERE task IN {REG} GROUP BY ALL")
def exact15_by_task(spark, sf):
    return L.exact15_by(ruled(spark, sf)).withColumn("exact15_acc", F.round("exact15_acc", 6))


@query("mean_of_means", RULED + f""", per AS (SELECT model, reasoning, task, avg(performance) AS mp FROM ruled GROUP BY ALL), {sql_canonical('per')}
SELECT canonical AS display_key, reasoning, task, CAST(round(avg(mp), 6) AS DOUBLE) AS performance FROM named GROUP BY ALL""")
def mean_of_means(spark, sf):
    return L.mean_of_means(ruled(spark, sf)).withColumn("performance", F.round("performance", 6))


@query("coverage", RULED + " SELECT model, reasoning, count(*) AS n_samples, CAST(round(avg(performance), 6) AS DOUBLE) AS mean_perf FROM ruled GROUP BY ALL")
def coverage(spark, sf):
    return L.coverage(ruled(spark, sf)).withColumn("mean_perf", F.round("mean_perf", 6))


_PIV = ", ".join(f"coalesce(max(CASE WHEN task = '{t}' THEN txt END), '-') AS \"{t}\"" for t in C.TASK_ORDER)


@query("leaderboard_pivot", RULED + f""", per AS (SELECT model, reasoning, task, avg(performance) AS mp FROM ruled GROUP BY ALL), {sql_canonical('per')},
  txt AS (SELECT display, reasoning, task, model, printf('%.1f', mp * 100) AS txt FROM named)
SELECT display AS "Model", reasoning AS "Reasoning", {_PIV} FROM txt GROUP BY display, reasoning, model""")
def leaderboard_pivot(spark, sf):
    return L.leaderboard_pivot(ruled(spark, sf))


@query("leaderboard_pivot_tokens", RULED + f""", per AS (SELECT model, reasoning, task, avg(tokens) AS mp FROM ruled GROUP BY ALL), {sql_canonical('per')},
  txt AS (SELECT display, reasoning, task, model, CAST(CAST(round_even(mp, 0) AS BIGINT) AS VARCHAR) AS txt FROM named)
SELECT display AS "Model", reasoning AS "Reasoning", {_PIV} FROM txt GROUP BY display, reasoning, model""")
def leaderboard_pivot_tokens(spark, sf):
    return L.leaderboard_pivot(ruled(spark, sf), "tokens")


@query("missing_cells", with_views("v_results") + f""",
  r AS (SELECT * REPLACE (CAST(l_orderkey AS VARCHAR) AS model) FROM v_results),
  c AS (SELECT DISTINCT model, reasoning FROM r), t AS (SELECT unnest([{', '.join(f"'{t}'" for t in C.TASKS)}]) AS task),
  p AS (SELECT DISTINCT model, reasoning, task FROM r),
  j AS (SELECT c.model, c.reasoning, t.task, p.task AS have FROM c CROSS JOIN t LEFT JOIN p ON p.model = c.model AND p.reasoning = c.reasoning AND p.task = t.task)
SELECT model, reasoning, CAST(count(have) AS INT) AS tasks_present, CAST(count(*) - count(have) AS INT) AS tasks_missing,
  coalesce(string_agg(CASE WHEN have IS NULL THEN task END, ';' ORDER BY task), '') AS missing_task_list FROM j GROUP BY model, reasoning""")
def missing_cells(spark, sf):
    # an order stands for a model: it has few lines, so most tasks are missing
    return L.missing_cells(view(spark, sf, "v_results").withColumn("model", F.col("l_orderkey").cast("string")))


@query("usage_overview", with_views("v_rows") + """,
  s AS (SELECT CASE WHEN o_custkey % 13 = 0 THEN NULL ELSE task END AS task, model, reasoning, cost, prompt_tokens + completion_tokens AS tokens, performance FROM v_rows),
  g AS (SELECT GROUPING(task, model, reasoning) AS gid, task, model, reasoning, count(*) AS n_samples, avg(cost) AS mean_cost, sum(cost) AS sum_cost,
    avg(tokens) AS mean_tokens, sum(tokens) AS sum_tokens, avg(performance) AS mean_score FROM s
    GROUP BY GROUPING SETS ((model), (task, model), (model, reasoning), (task, model, reasoning)))
SELECT CASE gid WHEN 5 THEN 'model' WHEN 1 THEN 'task_model' WHEN 4 THEN 'model_reasoning' ELSE 'task_model_reasoning' END AS level, task, model, reasoning,
  n_samples, round(CAST(coalesce(mean_cost, 0) AS DOUBLE), 12) AS mean_cost, round(CAST(coalesce(sum_cost, 0) AS DOUBLE), 6) AS sum_cost,
  round(coalesce(mean_tokens, 0), 6) AS mean_tokens, CAST(coalesce(sum_tokens, 0) AS BIGINT) AS sum_tokens, round(mean_score, 12) AS mean_score,
  round(CAST(coalesce(mean_cost, 0) AS DOUBLE) * 10000, 8) AS est_cost, round(coalesce(mean_tokens, 0) * 10000, 6) AS est_tokens FROM g""")
def usage_overview(spark, sf):
    t = view(spark, sf, "v_rows").withColumn("task", F.when(F.col("o_custkey") % 13 == 0, None).otherwise(F.col("task")))
    t = t.withColumn("tokens", F.col("prompt_tokens") + F.col("completion_tokens")).withColumn("cost", F.col("cost").cast("double"))
    g = L.usage_overview(t)
    rounded = {"mean_cost": 12, "sum_cost": 6, "mean_tokens": 6, "mean_score": 12, "est_cost": 8, "est_tokens": 6}
    return g.select(*[F.round(c, rounded[c]).alias(c) if c in rounded else F.col(c) for c in g.columns])


@query("completion_check", with_views("v_results") + """,
  g AS (SELECT GROUPING(reasoning) AS coarse, task, model, reasoning, count(*) AS n_rows FROM v_results GROUP BY GROUPING SETS ((task, model, reasoning), (task, model)))
SELECT CASE WHEN coarse = 1 THEN 'task_model' ELSE 'task_model_reasoning' END AS level, task, model, reasoning, n_rows,
  CASE WHEN coarse = 1 THEN n_rows >= 200 ELSE n_rows = 200 END AS ok FROM g""")
def completion_check(spark, sf):
    return L.completion(view(spark, sf, "v_results"), 200)


@query("melt_scores", RULED + """,
  m AS (SELECT task AS "Task", 'Accuracy' AS "Metric", model AS "Model", avg(performance) AS s FROM ruled WHERE task IN ('Addition', 'Division', 'MinMax') GROUP BY ALL
    UNION ALL SELECT task, 'Perplexity', model, avg(tokens) FROM ruled WHERE task IN ('Mean', 'Std') GROUP BY ALL)
SELECT "Task", "Metric", "Model", CASE WHEN "Metric" = 'Accuracy' THEN 'multi' ELSE 'solo' END AS source,
  CAST(round(CASE WHEN "Metric" = 'Accuracy' THEN CAST(printf('%.6f', s) AS DOUBLE) * 100 ELSE CAST(printf('%.6f', s) AS DOUBLE) END, 4) AS DOUBLE) AS value
FROM m WHERE s IS NOT NULL""")
def melt_scores(spark, sf):
    # every answer is parsed and scored once; two wide tables are laid out from the means
    means = ruled(spark, sf).groupBy(F.col("task").alias("Task"), "model").agg(F.avg("performance").alias("performance"), F.avg("tokens").alias("tokens"))
    means = materialized(means, "means")
    models = [m for m in ("deepseek__deepseek-chat-v3.1", "google__gemini-2.5-flash", "google__gemini-2.5-pro", "meta-llama__llama-4-maverick",
                          "moonshotai__kimi-k2-0905", "openai__gpt-5", "openai__gpt-oss-120b", "qwen__qwen3-235b-a22b-2507",
                          "qwen__qwen3-235b-a22b-thinking-2507")]

    def wide(metric, value):
        g = means.groupBy("Task").pivot("model", models).agg(F.first(value)).withColumn("Metric", F.lit(metric))
        return g.select("Task", "Metric", *[F.format_string("%.6f", F.col(f"`{m}`")).alias(m) for m in models])

    multi, solo = L.melt_scores(wide("Accuracy", "performance"), "multi"), L.melt_scores(wide("Perplexity", "tokens"), "solo")
    long = L.combine_scores([(multi, ["Addition", "Division", "MinMax"]), (solo, ["Mean", "Std"])])
    return long.select("Task", "Metric", "Model", "source", F.round("ValuePlot", 4).alias("value"))


@query("cumulative_mean", with_views("v_rows") + """,
  c AS (SELECT model, reasoning, task, row_number() OVER w AS k, avg(performance) OVER (w ROWS UNBOUNDED PRECEDING) AS m FROM v_rows
    WINDOW w AS (PARTITION BY model, reasoning, task ORDER BY row_idx))
SELECT model, reasoning, task, k, round(m, 12) AS mean FROM c WHERE k % 10 = 0""")
def cumulative_mean(spark, sf):
    return L.cumulative_mean(view(spark, sf, "v_rows")).withColumn("mean", F.round("mean", 12))


def _curve_sql(at: str) -> str:
    return RULED + f""",
  x AS (SELECT *, min(difficulty_sd) OVER g AS lo, max(difficulty_sd) OVER g AS hi FROM ruled WINDOW g AS (PARTITION BY model, reasoning, task)),
  b AS (SELECT model, reasoning, task, lo, hi, CAST({at} AS INT) AS bin, avg(performance) AS m FROM x WHERE hi > lo GROUP BY ALL),
  k AS (SELECT *, count(*) OVER (PARTITION BY model, reasoning, task) AS n, sum(m) OVER (PARTITION BY model, reasoning, task ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s
    FROM b WHERE bin < 40)
SELECT model, reasoning, task, bin, round(lo + (bin + 0.5) * (hi - lo) / 40, 6) AS center, CAST(round(CASE WHEN n >= 5 THEN s / 5 ELSE m END, 6) AS DOUBLE) AS value FROM k"""


def _curve(spark, sf, keep_max):
    t = L.difficulty_curve(ruled(spark, sf), keep_max=keep_max)
    return t.withColumn("center", F.round("center", 6)).withColumn("value", F.round("value", 6))


@query("difficulty_curve", _curve_sql("least(floor((difficulty_sd - lo) * 40 / (hi - lo)), 39)"))
def difficulty_curve(spark, sf):
    return _curve(spark, sf, True)


@query("difficulty_curve_open", _curve_sql("floor((difficulty_sd - lo) * 40 / (hi - lo))"))
def difficulty_curve_open(spark, sf):
    return _curve(spark, sf, False)


@query("head_per_group", with_views("v_rows") + """,
  r AS (SELECT *, row_number() OVER (PARTITION BY task, model, reasoning ORDER BY row_idx) AS rn FROM v_rows)
SELECT task, model, reasoning, row_idx, answer FROM r WHERE rn <= 20""")
def head_per_group(spark, sf):
    return L.head_per_group(view(spark, sf, "v_rows"), ["task", "model", "reasoning"], n=20).select("task", "model", "reasoning", "row_idx", "answer")


@query("tail_examples", with_views("v_history") + """,
  r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY event_id DESC) AS from_end FROM v_history)
SELECT task, event_id, difficulty, acc, CAST(from_end AS INT) AS from_end FROM r WHERE from_end <= 10""")
def tail_examples(spark, sf):
    return L.tail_examples(view(spark, sf, "v_history"), ["task"], "event_id").select("task", "event_id", "difficulty", "acc", "from_end")


# ---- problem statistics ----

@query("count_grid", with_views("v_problems") + """
SELECT num2_exp, count(*) FILTER (num1_exp = 2) AS "2", count(*) FILTER (num1_exp = 3) AS "3", count(*) FILTER (num1_exp = 4) AS "4", count(*) FILTER (num1_exp = 5) AS "5"
FROM v_problems GROUP BY num2_exp""")
def count_grid(spark, sf):
    return L.grid(view(spark, sf, "v_problems"), "num1_exp", "num2_exp", [2, 3, 4, 5])


@query("accuracy_grid", RULED + """
SELECT task, CAST(round(avg(performance) FILTER (reasoning = 'none'), 6) AS DOUBLE) AS "none", CAST(round(avg(performance) FILTER (reasoning = 'low'), 6) AS DOUBLE) AS "low",
  CAST(round(avg(performance) FILTER (reasoning = 'maximal'), 6) AS DOUBLE) AS "maximal" FROM ruled GROUP BY task""")
def accuracy_grid(spark, sf):
    levels = ["none", "low", "maximal"]
    g = L.grid(ruled(spark, sf), "reasoning", "task", levels, "performance")
    return g.select("task", *[F.round(c, 6).alias(c) for c in levels])


@query("difficulty_histogram", with_views("v_rows") + """,
  d AS (SELECT task, row_idx, CAST(o_custkey % 37 AS INT) AS difficulty_sd, row_number() OVER (PARTITION BY task ORDER BY row_idx) AS rn FROM v_rows),
  st AS (SELECT min(difficulty_sd) AS lo, max(difficulty_sd) AS hi, greatest(2 * (quantile_cont(difficulty_sd, 0.75) - quantile_cont(difficulty_sd, 0.25))
    / pow(count(*), 1.0 / 3.0), 1.0) AS w FROM d),
  s AS (SELECT task, 'all' AS subset, difficulty_sd FROM d UNION ALL SELECT task, 'first', difficulty_sd FROM d WHERE rn <= 500),
  b AS (SELECT task, subset, CAST(least(floor((difficulty_sd - lo) * ceil((hi - lo) / w) / (hi - lo)), ceil((hi - lo) / w) - 1) AS INT) AS bin FROM s, st)
SELECT task, subset, bin, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY task, subset), 9) AS share FROM b GROUP BY task, subset, bin""")
def difficulty_histogram(spark, sf):
    t = view(spark, sf, "v_rows").select("task", "row_idx", (F.col("o_custkey") % 37).cast("int").alias("difficulty_sd"))
    return L.difficulty_histogram(t).withColumn("share", F.round("share", 9))


@query("difficulty_describe", with_views("v_results") + """
SELECT task, count(*) AS count, round(avg(difficulty_sd), 6) AS mean, round(stddev_samp(difficulty_sd), 6) AS std, CAST(min(difficulty_sd) AS DOUBLE) AS min,
  quantile_cont(difficulty_sd, 0.25) AS q25, quantile_cont(difficulty_sd, 0.5) AS q50, quantile_cont(difficulty_sd, 0.75) AS q75, CAST(max(difficulty_sd) AS DOUBLE) AS max
FROM v_results GROUP BY task""")
def difficulty_describe(spark, sf):
    g = L.describe(view(spark, sf, "v_results"), "difficulty_sd", ["task"])
    return g.withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@query("ratio_describe", """WITH r AS (SELECT l_returnflag, l_extendedprice / (l_quantity + 0.37) AS ratio FROM lineitem)
SELECT l_returnflag, count(*) AS count, round(avg(ratio), 6) AS mean, round(stddev_samp(ratio), 6) AS std, min(ratio) AS min, round(quantile_cont(ratio, 0.25), 6) AS q25,
  round(quantile_cont(ratio, 0.5), 6) AS q50, round(quantile_cont(ratio, 0.75), 6) AS q75, max(ratio) AS max FROM r GROUP BY l_returnflag""")
def ratio_describe(spark, sf):
    """Nearly every value is there once, and a few groups hold all rows."""
    t = table(spark, sf, "lineitem").select("l_returnflag", (F.col("l_extendedprice") / (F.col("l_quantity") + F.lit(0.37))).alias("ratio"))
    g = L.describe(t, "ratio", ["l_returnflag"])
    return g.select(*[F.round(c, 6).alias(c) if c in ("mean", "std", "q25", "q50", "q75") else F.col(c) for c in g.columns])


# ---- evaluation of a run ----

@query("acc_by_difficulty", with_views("v_history") + """,
  g AS (SELECT task, difficulty, avg(acc) AS acc, count(*) AS n FROM v_history GROUP BY ALL)
SELECT task, difficulty, round(acc, 12) AS acc, n, round(n / sum(n) OVER (PARTITION BY task), 9) AS share,
  round(sum(difficulty * n) OVER (PARTITION BY task) / sum(n) OVER (PARTITION BY task), 6) AS mean_difficulty FROM g""")
def acc_by_difficulty(spark, sf):
    g = L.acc_by_difficulty(view(spark, sf, "v_history"), ["task"])
    return g.select("task", "difficulty", F.round("acc", 12).alias("acc"), "n", F.round("share", 9).alias("share"), F.round("mean_difficulty", 6).alias("mean_difficulty"))


@query("sample_rollup", with_views("v_preds") + f"""
SELECT l_orderkey, count(*) AS n_numbers, bool_and({sql_log_smape('pred', 'truth')} > 0.1) AS correct, round(avg({sql_log_smape('pred', 'truth')}), 6) AS score
FROM v_preds GROUP BY l_orderkey""")
def sample_rollup(spark, sf):
    t = view(spark, sf, "v_preds").withColumn("score", M.log_smape(F.col("pred"), F.col("truth")))
    return L.sample_rollup(t, "l_orderkey", "score", 0.1).withColumn("score", F.round("score", 6))


@query("batch_means", with_views("v_history") + """,
  b AS (SELECT task, event_id // 32 AS batch, avg(acc) AS m, sum(acc) AS s, count(*) AS n FROM v_history GROUP BY ALL)
SELECT task, round(avg(m), 12) AS mean_of_batches, round(sum(s) / sum(n), 12) AS mean_of_rows, count(*) AS n_batches FROM b GROUP BY task""")
def batch_means(spark, sf):
    t = view(spark, sf, "v_history").withColumn("batch", F.floor(F.col("event_id") / 32))
    return L.batch_means(t, "batch", "acc", ["task"]).withColumn("mean_of_batches", F.round("mean_of_batches", 12)).withColumn("mean_of_rows", F.round("mean_of_rows", 12))


@query("perplexity_by_scope", """
WITH t AS (SELECT event_type, event_id // 64 AS batch, value / 100 AS loss, user_id % 3 = 0 AS num, user_id % 3 = 1 AS near FROM events),
  b AS (SELECT event_type, batch, avg(loss) AS b, sum(loss) FILTER (NOT num) AS t, count(*) FILTER (NOT num) AS tn, sum(loss) FILTER (NOT num AND near) AS r,
    count(*) FILTER (NOT num AND near) AS rn FROM t GROUP BY ALL)
SELECT event_type, round(avg(exp(b)), 6) AS perplexity, round(exp(sum(t) / sum(tn)), 6) AS text_perplexity, round(exp(sum(r) / sum(rn)), 6) AS numeric_text_perplexity
FROM b GROUP BY event_type""")
def perplexity_by_scope(spark, sf):
    t = table(spark, sf, "events").select(
        "event_type", F.floor(F.col("event_id") / 64).alias("batch"), (F.col("value") / 100).alias("loss"),
        (F.col("user_id") % 3 == 0).alias("is_number"), (F.col("user_id") % 3 == 1).alias("near_number"),
    )
    g = L.perplexity_by_scope(t, ["event_type"])
    return g.select("event_type", *[F.round(c, 6).alias(c) for c in g.columns if c != "event_type"])


@query("generalized_mean", with_views("v_history") + """,
  a AS (SELECT task, greatest(avg(acc), 0.01) AS acc FROM v_history GROUP BY task)
SELECT -1.0::DOUBLE AS p, round(1 / avg(1 / acc), 6) AS mean FROM a UNION ALL SELECT 0.0::DOUBLE, round(exp(avg(ln(acc))), 6) FROM a
UNION ALL SELECT 1.0::DOUBLE, round(avg(acc), 6) FROM a UNION ALL SELECT 2.0::DOUBLE, round(sqrt(avg(acc * acc)), 6) FROM a""")
def generalized_mean(spark, sf):
    per_task = view(spark, sf, "v_history").groupBy("task").agg(F.avg("acc").alias("acc"))
    return L.generalized_means(per_task, [-1.0, 0.0, 1.0, 2.0]).withColumn("mean", F.round("mean", 6))


@query("task_weights", with_views("v_history") + """,
  a AS (SELECT task, avg(acc) AS acc FROM v_history GROUP BY task), w AS (SELECT *, pow(greatest(1 - acc, 0.01), 2) AS w FROM a)
SELECT task, round(acc, 6) AS acc, round(w / sum(w) OVER (), 6) AS weight FROM w""")
def task_weights(spark, sf):
    per_task = view(spark, sf, "v_history").groupBy("task").agg(F.avg("acc").alias("acc"))
    return L.task_weights(per_task, p=-1.0).select("task", F.round("acc", 6).alias("acc"), F.round("weight", 6).alias("weight"))


_NAME = """CASE user_id % 5 WHEN 0 THEN concat('val_gen_acc_', event_type) WHEN 1 THEN concat('train_loss_', event_type) WHEN 2 THEN 'lr'
  WHEN 3 THEN concat('additional_metrics_', event_type, '.csv.gz_exact_number_acc') ELSE concat('additional_metrics_', event_type, '_logSMAPE') END"""
_VALUE = "CASE WHEN user_id % 7 = 0 THEN NULL ELSE CAST(CAST(value AS DECIMAL(10,2)) AS DOUBLE) END"


@query("metrics_log", f"""
WITH t AS (SELECT event_id AS step, event_type, user_id % 5 AS kind, {_VALUE} AS value FROM events WHERE event_id <= (SELECT max(event_id) FROM events WHERE user_id % 5 = 2)),
  n AS (SELECT step // 250 AS "interval", CASE kind WHEN 0 THEN 'val_gen_acc' WHEN 1 THEN 'train_loss' WHEN 2 THEN 'lr' ELSE 'additional_metrics' END AS family,
    CASE kind WHEN 2 THEN '' WHEN 3 THEN event_type || '.csv.gz' ELSE event_type END AS dataset,
    CASE kind WHEN 3 THEN 'exact_number_acc' WHEN 4 THEN 'logSMAPE' ELSE '' END AS metric, step, value FROM t)
SELECT "interval", family, dataset, metric, round(CASE WHEN family = 'train_loss' THEN coalesce(avg(value), 0.0) ELSE avg(value) END, 6) AS mean,
  max(step) AS last_step, max(CASE WHEN step = top THEN value END) AS last_value
FROM (SELECT *, max(step) OVER (PARTITION BY "interval", family, dataset, metric) AS top FROM n) GROUP BY "interval", family, dataset, metric""")
def metrics_log(spark, sf):
    t = table(spark, sf, "events").select(F.col("event_id").alias("step"), F.expr(_NAME).alias("name"), F.expr(_VALUE).alias("value"))
    # up to the last checkpoint, that is the last step with a learning rate
    return L.metrics_log(t, 250, t.filter("name = 'lr'").agg(F.max("step")).scalar()).withColumn("mean", F.round("mean", 6))


@query("flatten_metrics", """
WITH g AS (SELECT user_id, event_type, max(value) AS v FROM events GROUP BY ALL), s AS (SELECT user_id, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, 'val_gen_acc_' || event_type AS name, v AS value FROM g UNION ALL SELECT user_id, 'num_tokens', CAST(n AS DOUBLE) FROM s""")
def flatten_metrics(spark, sf):
    per = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("v"), F.count("*").alias("n"))
    # five kinds of event per user
    nested = per.groupBy("user_id").agg(F.sum("n").alias("num_tokens"), F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("val_gen_acc"))
    return L.flatten_metrics(nested, ["user_id"])


# ---- result sets ----

_RUNS = """
  h1 AS (SELECT row_idx, task, model, answer, response AS raw_response, completion_tokens AS tokens, prompt_tokens AS only_h1 FROM v_rows),
  h2 AS (SELECT row_idx, task, model, answer, CASE WHEN row_idx % 3 = 0 THEN NULL ELSE 'second run' END AS raw_response,
    CASE WHEN row_idx % 100 = 0 THEN 65535 ELSE completion_tokens + 1 END AS tokens, cost AS only_h2 FROM v_rows)"""


def _runs(spark, sf):
    t = view(spark, sf, "v_rows")
    h1 = t.select("row_idx", "task", "model", "answer", F.col("response").alias("raw_response"), F.col("completion_tokens").alias("tokens"), F.col("prompt_tokens").alias("only_h1"))
    h2 = t.select(
        "row_idx", "task", "model", "answer", F.when(F.col("row_idx") % 3 == 0, None).otherwise("second run").alias("raw_response"),
        F.when(F.col("row_idx") % 100 == 0, 65535).otherwise(F.col("completion_tokens") + 1).alias("tokens"), F.col("cost").alias("only_h2"),
    )
    return R.merge_runs(h1, h2, ["row_idx"])


_MERGED = f"""{_RUNS},
  m AS (SELECT h1.*, h2.raw_response AS r2, h2.tokens AS t2, h2.only_h2, coalesce(trim(h1.raw_response), '') = '' AS e1, coalesce(trim(h2.raw_response), '') = '' AS e2
    FROM h1 FULL JOIN h2 USING (row_idx))"""


@query("merge_runs", with_views("v_rows") + f""",{_MERGED}
SELECT row_idx, task, model, answer, CASE WHEN e1 AND e2 AND tokens = 65535 AND t2 = 65535 THEN 'Token limit reached' WHEN e1 AND NOT e2 THEN r2 ELSE raw_response END AS raw_response,
  CASE WHEN e1 AND NOT e2 THEN t2 ELSE tokens END AS tokens, CASE WHEN e1 AND NOT e2 THEN NULL ELSE only_h1 END AS only_h1, CAST(only_h2 AS DOUBLE) AS only_h2 FROM m""")
def merge_runs(spark, sf):
    return _runs(spark, sf)[0].withColumn("only_h2", F.col("only_h2").cast("double"))


@query("merge_runs_warnings", with_views("v_rows") + f""",{_MERGED}
SELECT row_idx, tokens AS tokens_h1, t2 AS tokens_h2 FROM m WHERE e1 AND e2 AND NOT (tokens = 65535 AND t2 = 65535)""")
def merge_runs_warnings(spark, sf):
    return _runs(spark, sf)[1]


@query("token_limit_marker", with_views("v_rows") + """
SELECT row_idx, CASE WHEN completion_tokens = 65535 THEN 'Token limit reached' ELSE response END AS raw_response FROM v_rows""")
def token_limit_marker(spark, sf):
    return view(spark, sf, "v_rows").select("row_idx", A.mark_token_limit("response", "completion_tokens").alias("raw_response"))


_ORDERED = """
  num AS (SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY row_idx) - 1 AS BIGINT) AS seq FROM v_rows),
  can AS (SELECT o_custkey, text_prompt, answer, seq AS pos FROM num),
  res AS (SELECT o_custkey, ' ' || text_prompt AS text_prompt, response, row_idx FROM v_rows WHERE response IS NOT NULL
    UNION ALL SELECT o_custkey, text_prompt, 'again', row_idx + 100000000 FROM v_rows WHERE response LIKE '%1%')"""
_PREFIX = _ORDERED + """,
  fst AS (SELECT o_custkey, trim(text_prompt) AS p, arg_min(response, row_idx) AS response, min(row_idx) AS row_idx, count(*) AS times FROM res GROUP BY ALL),
  fnd AS (SELECT can.*, fst.response, fst.row_idx, fst.times FROM can LEFT JOIN fst ON fst.o_custkey = can.o_custkey AND fst.p = trim(can.text_prompt)
    WHERE can.o_custkey IN (SELECT o_custkey FROM res)),
  ct AS (SELECT o_custkey, min(pos) FILTER (row_idx IS NULL) AS cut, count(*) AS n_canonical FROM fnd GROUP BY ALL),
  kept AS (SELECT fnd.*, cut FROM fnd JOIN ct USING (o_custkey) WHERE row_idx IS NOT NULL AND (cut IS NULL OR pos < cut))"""


def _prefix(spark, sf):
    t = view(spark, sf, "v_rows")
    # canonical prompts are numbered per customer; the two-step rank keeps a large customer out of one task
    from tallyforge.operators.prefix import ranked
    can = ranked(t, ["o_custkey"], "row_idx").select("o_custkey", "text_prompt", "answer", (F.col("rn") - 1).alias("pos"))
    res = t.filter("response IS NOT NULL").select("o_custkey", F.concat(F.lit(" "), "text_prompt").alias("text_prompt"), "response", "row_idx")
    again = t.filter("response LIKE '%1%'").select("o_custkey", "text_prompt", F.lit("again").alias("response"), (F.col("row_idx") + 100000000).alias("row_idx"))
    return R.canonical_prefix(res.unionByName(again), can, ["o_custkey"])


@query("canonical_prefix", with_views("v_rows") + f",{_PREFIX} SELECT o_custkey, pos, row_idx, response FROM kept")
def canonical_prefix(spark, sf):
    return _prefix(spark, sf)[0].select("o_custkey", "pos", "row_idx", "response")


@query("canonical_prefix_report", with_views("v_rows") + f""",{_PREFIX},
  d AS (SELECT o_custkey, CAST(sum(CASE WHEN times > 1 THEN 1 ELSE 0 END) AS BIGINT) AS duplicate_prompts, CAST(sum(times - 1) AS BIGINT) AS duplicate_rows, sum(times) AS n_results FROM fst GROUP BY ALL),
  k AS (SELECT o_custkey, count(*) AS n_kept, bool_or(row_idx <> pos) AS moved FROM kept GROUP BY ALL), r AS (SELECT o_custkey, count(*) AS n_rows FROM res GROUP BY ALL)
SELECT ct.o_custkey, coalesce(n_kept, 0) AS n_kept, duplicate_prompts, duplicate_rows, cut AS first_missing, n_canonical - coalesce(n_kept, 0) AS n_cut,
  coalesce(n_kept, 0) <> n_rows OR coalesce(moved, false) AS changed
FROM ct JOIN r ON r.o_custkey = ct.o_custkey LEFT JOIN k ON k.o_custkey = ct.o_custkey LEFT JOIN d ON d.o_custkey = ct.o_custkey""")
def canonical_prefix_report(spark, sf):
    return _prefix(spark, sf)[1]


_ASKED = """
  inp AS (SELECT row_idx, CAST(o_custkey AS VARCHAR) || ' of ' || task AS text_prompt FROM v_rows),
  res AS (SELECT CAST(o_custkey AS VARCHAR) || ' of ' || task AS text_prompt, response AS raw_response FROM v_rows WHERE o_totalprice > 150000)"""


def _asked(spark, sf):
    t = view(spark, sf, "v_rows").withColumn("text_prompt", F.concat(F.col("o_custkey").cast("string"), F.lit(" of "), "task"))
    return t.select("row_idx", "text_prompt"), t.filter("o_totalprice > 150000").select("text_prompt", F.col("response").alias("raw_response"))


@query("resume_worklist", with_views("v_rows") + f""",{_ASKED},
  done AS (SELECT DISTINCT text_prompt FROM res WHERE coalesce(trim(raw_response), '') <> ''),
  retry AS (SELECT DISTINCT text_prompt FROM res WHERE coalesce(trim(raw_response), '') = ''),
  work AS (SELECT row_idx, text_prompt, 0 AS k FROM inp WHERE text_prompt IN (SELECT text_prompt FROM retry)
    UNION ALL SELECT row_idx, text_prompt, 1 FROM inp WHERE text_prompt NOT IN (SELECT text_prompt FROM retry) AND text_prompt NOT IN (SELECT text_prompt FROM done)),
  r AS (SELECT *, row_number() OVER (ORDER BY k, row_idx) AS rn FROM work)
SELECT row_idx, text_prompt, CASE WHEN k = 0 THEN 'retry' ELSE 'new' END AS kind FROM r WHERE rn <= (SELECT count(DISTINCT text_prompt) FROM inp) - (SELECT count(*) FROM done)""")
def resume_worklist(spark, sf):
    inputs, results = _asked(spark, sf)
    # as many answers are wanted as there are different prompts
    return R.resume_worklist(inputs, results, inputs.agg(F.count_distinct("text_prompt")).scalar())


@query("upsert_results", with_views("v_rows") + """,
  old AS (SELECT row_idx, CAST(o_custkey % 500 AS VARCHAR) AS text_prompt, response AS raw_response, prompt_tokens FROM v_rows),
  new AS (SELECT o_orderkey AS row_idx, CASE WHEN o_custkey % 90 = 7 THEN '' ELSE CAST(o_custkey % 700 AS VARCHAR) END AS text_prompt, 'update' AS raw_response, cost FROM v_rows),
  holes AS (SELECT *, row_number() OVER (PARTITION BY text_prompt ORDER BY row_idx) AS k FROM old WHERE coalesce(trim(raw_response), '') = ''),
  upd AS (SELECT *, row_number() OVER (PARTITION BY text_prompt ORDER BY row_idx) AS k FROM new WHERE text_prompt <> ''),
  pairs AS (SELECT h.row_idx, u.row_idx AS upd_idx, coalesce(u.text_prompt, h.text_prompt) AS text_prompt, CASE WHEN u.k IS NULL THEN h.raw_response ELSE u.raw_response END AS raw_response,
    CASE WHEN u.k IS NULL THEN h.prompt_tokens END AS prompt_tokens, u.cost FROM holes h FULL JOIN upd u ON u.text_prompt = h.text_prompt AND u.k = h.k)
SELECT row_idx, upd_idx, text_prompt, raw_response, prompt_tokens, CAST(cost AS DOUBLE) AS cost FROM pairs
UNION ALL SELECT row_idx, NULL, text_prompt, raw_response, prompt_tokens, NULL FROM old WHERE coalesce(trim(raw_response), '') <> ''
UNION ALL SELECT NULL, row_idx, text_prompt, raw_response, NULL, CAST(cost AS DOUBLE) FROM new WHERE text_prompt = ''""")
def upsert_results(spark, sf):
    t = view(spark, sf, "v_rows")
    old = t.select("row_idx", (F.col("o_custkey") % 500).cast("string").alias("text_prompt"), F.col("response").alias("raw_response"), "prompt_tokens")
    prompt = F.when(F.col("o_custkey") % 90 == 7, "").otherwise((F.col("o_custkey") % 700).cast("string"))
    new = t.select("row_idx", prompt.alias("text_prompt"), F.lit("update").alias("raw_response"), F.col("cost").cast("double").alias("cost"))
    return R.upsert_results(old, new)


@query("answer_mismatch", with_views("v_rows") + """,
  own AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY row_idx) - 1 AS i FROM v_rows),
  w AS (SELECT task, i, row_number() OVER (PARTITION BY task ORDER BY i) AS rn FROM own
    WHERE (CASE WHEN o_custkey % 17 = 0 THEN answer || '1' ELSE ' ' || answer END) NOT IN (answer, ' ' || answer))
SELECT task, count(*) AS n_mismatches, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) FILTER (rn <= 5) AS first_positions FROM w GROUP BY task""")
def answer_mismatch(spark, sf):
    # every task has a list of its own, numbered from 0
    t = ranked(view(spark, sf, "v_rows"), ["task"], "row_idx", "_rn").withColumn("row_idx", F.col("_rn") - 1).drop("_rn")
    ours = t.withColumn("answer", F.when(F.col("o_custkey") % 17 == 0, F.concat("answer", F.lit("1"))).otherwise(F.concat(F.lit(" "), "answer")))
    return R.answer_mismatch(ours, t, ["task"])


@query("new_cost", with_views("v_rows") + """,
  s AS (SELECT *, CASE WHEN row_idx % 2 = 0 THEN 'H1' ELSE 'H2' END AS run,
    CASE WHEN model LIKE '%gemini-2.5-flash%' THEN 0.15 / 1000000 WHEN model LIKE '%gemini-2.5-pro%' THEN 0.625 / 1000000 END AS pr,
    CASE WHEN model LIKE '%gemini-2.5-flash%' THEN 1.25 / 1000000 WHEN model LIKE '%gemini-2.5-pro%' THEN 5.0 / 1000000 END AS cr FROM v_rows)
SELECT model, task, run, CAST(round(sum(CASE WHEN cost IS NULL THEN prompt_tokens * pr + completion_tokens * cr ELSE 0 END), 6) AS DOUBLE) AS costs,
  count(*) FILTER (completion_tokens = 65535) AS "MAX_TOKENS" FROM s WHERE pr IS NOT NULL GROUP BY model, task, run""")
def new_cost(spark, sf):
    t = view(spark, sf, "v_rows").withColumn("run", F.when(F.col("row_idx") % 2 == 0, "H1").otherwise("H2"))
    return R.new_cost(t, ["model", "task", "run"]).withColumn("costs", F.round("costs", 6))


@query("cost_by_model", with_views("v_rows") + """
SELECT model, reasoning, CAST(sum(cost) AS DOUBLE) AS sum_cost, CAST(sum(completion_tokens) AS BIGINT) AS sum_tokens FROM v_rows GROUP BY model, reasoning""")
def cost_by_model(spark, sf):
    t = view(spark, sf, "v_rows").withColumn("tokens", F.col("completion_tokens"))
    return R.cost_by_model(t).withColumn("sum_cost", F.col("sum_cost").cast("double"))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query("chat_requests", with_views("v_rows") + f""",
  shot AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY row_idx) AS rn FROM v_rows)
SELECT r.row_idx, r.task, 6 AS n_messages, md5(CASE r.task WHEN 'Interval' THEN {_sql_text(C.SYSTEM_MESSAGES['Interval'])} WHEN 'Sorting' THEN {_sql_text(C.SYSTEM_MESSAGES['Sorting'])}
  WHEN 'MinMax' THEN {_sql_text(C.SYSTEM_MESSAGES['MinMax'])} ELSE {_sql_text(C.SYSTEM_MESSAGES[''])} END) AS system_md5,
  a.text_prompt AS first_user, '{{"answer": ' || a.answer || '}}' AS first_assistant, r.text_prompt AS last_user
FROM v_rows r JOIN shot a ON a.task = r.task AND a.rn = 1""")
def chat_requests(spark, sf):
    t = R.chat_requests(view(spark, sf, "v_rows"), 2)
    m = F.col("messages")
    return t.select(
        "row_idx", "task", F.size(m).alias("n_messages"), F.md5(m[0]["content"]).alias("system_md5"), m[1]["content"].alias("first_user"),
        m[2]["content"].alias("first_assistant"), F.element_at(m, -1)["content"].alias("last_user"),
    )


def _schema_sql(name: str) -> str:
    return _sql_text('{"type": "json_schema", "json_schema": {"name": "answer_schema", "strict": true, "schema": {"type": "object", "properties": {"answer": '
                     + C.ANSWER_SCHEMAS[name] + '}, "required": ["answer"], "additionalProperties": false}}}')


_SHOWN = """CASE l_suppkey % 6 WHEN 1 THEN replace(raw_response, '}', ', "note": 1}') WHEN 2 THEN replace(raw_response, '"answer"', '"result"')
    WHEN 3 THEN replace(raw_response, ']', ', null]') WHEN 4 THEN replace(replace(raw_response, '{"answer": ', ''), '}', '') ELSE raw_response END"""
_ASKED_TASK = "CASE l_suppkey % 10 WHEN 7 THEN 'Interval' WHEN 8 THEN 'Sorting' ELSE task END"


@query("schema_violations", with_views("v_results") + f""",
  s AS (SELECT {_ASKED_TASK} AS task, TRY_CAST({_SHOWN} AS JSON) AS j FROM v_results),
  a AS (SELECT *, json_type(j) AS kind, CASE WHEN json_type(j) = 'OBJECT' THEN json_keys(j) END AS fields, json_type(j, '$.answer') AS value,
    CASE WHEN json_type(j, '$.answer') = 'ARRAY' THEN json_extract(j, '$.answer[*]') END AS items FROM s)
SELECT task, CASE WHEN j IS NULL THEN 'not_json' WHEN kind <> 'OBJECT' THEN 'not_object' WHEN NOT list_contains(fields, 'answer') THEN 'missing_field' WHEN len(fields) > 1 THEN 'extra_field'
    WHEN task = 'Interval' THEN CASE WHEN value <> 'VARCHAR' THEN 'wrong_type' WHEN json_extract_string(j, '$.answer') NOT IN ('A', 'B', 'C', 'D', 'E', 'F') THEN 'not_in_enum' END
    WHEN task = 'Sorting' THEN CASE WHEN value <> 'ARRAY' THEN 'wrong_type' WHEN len([x FOR x IN items IF json_type(x) NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE')]) > 0 THEN 'wrong_item' END
    WHEN value NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'wrong_type' END AS violation,
  count(*) AS n, any_value(md5(CASE task WHEN 'Interval' THEN {_schema_sql('Interval')} WHEN 'Sorting' THEN {_schema_sql('Sorting')} ELSE {_schema_sql('')} END)) AS schema_md5
FROM a GROUP BY 1, 2""")
def schema_violations(spark, sf):
    """Responses held against their task's schema; some get a field too many, another field, a null item, no object or another task."""
    t = view(spark, sf, "v_results").select(F.expr(_ASKED_TASK).alias("task"), F.expr(_SHOWN).alias("shown"))
    found = t.select("task", R.schema_violation(F.col("shown"), F.col("task")).alias("violation"))
    return found.groupBy("task", "violation").agg(F.count("*").alias("n")).withColumn("schema_md5", F.md5(R.response_schema(F.col("task"))))


@query("union_by_name", with_views("v_rows") + """
SELECT model, CAST(NULL AS DOUBLE) AS cost, TRY_CAST(answer AS DOUBLE) AS number, prompt_tokens FROM v_rows
UNION ALL SELECT model, CAST(cost AS DOUBLE), TRY_CAST(response AS DOUBLE), NULL FROM v_rows""")
def union_by_name(spark, sf):
    from tallyforge.sources.files import union_results
    t = view(spark, sf, "v_rows")
    first = t.select("model", F.col("answer").alias("number"), "prompt_tokens")
    second = t.select("model", F.col("cost").cast("string").alias("cost"), F.col("response").alias("number"))
    return union_results(first, second, numeric=["cost", "number"])


@query("dims_from_filename", with_views("v_results") + """
SELECT task, replace(model, '__', '/') AS model, reasoning, count(*) AS n FROM v_results GROUP BY ALL""")
def dims_from_filename(spark, sf):
    from tallyforge.sources.files import parse_file_name
    name = F.concat("task", F.lit("_decimal_uniform_test_10k_shuffle_"), "model", F.lit("_re_"), "reasoning", F.lit(".csv"))
    t = view(spark, sf, "v_results").select(name.alias("file")).groupBy("file").agg(F.count("*").alias("n"))
    return t.select(parse_file_name("file").alias("d"), "n").select("d.task", "d.model", "d.reasoning", "n")
