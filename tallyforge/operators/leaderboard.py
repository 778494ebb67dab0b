"""From scored rows to leaderboard tables, curves and coverage reports."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge import constants as C
from tallyforge.functions import metrics as M
from tallyforge.functions.answers import is_strict_json
from tallyforge.operators.prefix import quantile_slices, quantiles, running_totals

GROUP = ["model", "reasoning", "task"]


# ---- rules ----

def has_part(model: Column, part: str) -> Column:
    return F.contains(F.lower(model), F.lit(part))


def exclude_models(df: DataFrame) -> DataFrame:
    """Rows without the models and (model, reasoning) pairs that no table shows."""
    out = df.filter(~F.col("model").isin(C.EXCLUDED_MODELS) & ~has_part(F.col("model"), C.EXCLUDED_MODEL_PART))
    for model, reasoning in C.EXCLUDED_PAIRS:
        out = out.filter(~((F.col("model") == model) & (F.col("reasoning") == reasoning)))
    return out


def apply_rules(df: DataFrame, missing_as_minus_one: bool = True, drop_limit: bool = False) -> DataFrame:
    """Exclusions, token clean-up and level names.

    Missing token counts become -1 (and enter means as such) unless switched off; `drop_limit` also
    drops rows without a valid count and rows at the output limit, as the token curves do.
    """
    t = exclude_models(df)
    if missing_as_minus_one:
        t = t.withColumn("tokens", F.coalesce(F.col("tokens"), F.lit(-1)))
    if drop_limit:
        t = t.filter((F.col("tokens") != C.TOKEN_LIMIT) & (F.col("tokens") >= 0))
    tokenless = has_part(F.col("model"), C.TOKENLESS_MODEL_PART) & (F.lower("reasoning") == C.TOKENLESS_REASONING) & (F.col("tokens") > C.TOKENLESS_ABOVE)
    t = t.withColumn("tokens", F.when(tokenless, None).otherwise(F.col("tokens")))
    return t.withColumn("reasoning", F.when(F.col("reasoning") == "high", "maximal").otherwise(F.col("reasoning")))


def _by_rules(model: Column, pick: int, otherwise: Column) -> Column:
    name = F.lower(F.replace(model, F.lit("__"), F.lit("/")))
    out = None
    for rule in C.MODEL_RULES:
        hit = reduce(lambda a, b: a | b, [F.contains(name, F.lit(part)) for part in rule[0]])
        out = F.when(hit, rule[pick]) if out is None else out.when(hit, rule[pick])
    return out.otherwise(otherwise)


def canonical_model(model: Column) -> Column:
    """Key shared by the variants of a model; an unknown model keeps its lower-case name."""
    return _by_rules(model, 1, F.lower(F.replace(model, F.lit("__"), F.lit("/"))))


def display_model(model: Column) -> Column:
    """Display name of a model; an unknown model keeps its name."""
    return _by_rules(model, 2, F.replace(model, F.lit("__"), F.lit("/")))


def _rank(value: Column, order: list[str]) -> Column:
    at = F.array_position(F.array(*[F.lit(v) for v in order]), value)
    return F.when(at > 0, at).otherwise(len(order) + 1)


# ---- aggregates ----

def perf_by(df: DataFrame, keys: list[str] = GROUP) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg("performance").alias("mean_performance"))


def tokens_perf(df: DataFrame) -> DataFrame:
    """Mean tokens (nulls left out) and mean performance by task, model and reasoning."""
    return df.groupBy("task", "model", "reasoning").agg(F.avg("tokens").alias("avg_tokens"), F.avg("performance").alias("avg_perf"))


def exact15_by(df: DataFrame) -> DataFrame:
    """Share of exact 15-digit answers, for the tasks with a continuous score."""
    return df.filter(F.col("task").isin(C.REGRESSION_TASKS)).groupBy(*GROUP).agg(F.avg("exact15").alias("exact15_acc"))


def mean_of_means(df: DataFrame) -> DataFrame:
    """Mean per model first, then the mean of these means per canonical model."""
    per_model = perf_by(df).withColumn("display_key", canonical_model(F.col("model")))
    return per_model.groupBy("display_key", "reasoning", "task").agg(F.avg("mean_performance").alias("performance"))


def coverage(df: DataFrame) -> DataFrame:
    return df.groupBy("model", "reasoning").agg(F.count("*").alias("n_samples"), F.avg("performance").alias("mean_perf"))


def usage_overview(df: DataFrame, n_target: int = 10_000) -> DataFrame:
    """Cost, tokens and score at four levels in one pass; empty keys stay groups of their own.

    `level` tells a total over all tasks from a group whose task is empty.
    """
    task, model, reasoning = F.col("task"), F.col("model"), F.col("reasoning")
    sets = [[model], [task, model], [model, reasoning], [task, model, reasoning]]
    level = F.when(F.grouping_id() == 5, "model").when(F.grouping_id() == 1, "task_model").when(F.grouping_id() == 4, "model_reasoning").otherwise("task_model_reasoning")
    g = df.groupingSets(sets, task, model, reasoning).agg(
        level.alias("level"), F.count("*").alias("n_samples"), F.avg("cost").alias("mean_cost"), F.sum("cost").alias("sum_cost"),
        F.avg("tokens").alias("mean_tokens"), F.sum("tokens").alias("sum_tokens"), F.avg("performance").alias("mean_score"),
    )
    zero = ["mean_cost", "sum_cost", "mean_tokens", "sum_tokens"]
    g = g.select("level", "task", "model", "reasoning", "n_samples", "mean_score", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in zero])
    return g.withColumn("est_cost", F.col("mean_cost") * n_target).withColumn("est_tokens", F.col("mean_tokens") * n_target)


def completion(df: DataFrame, expected: int = C.EXPECTED_PER_GROUP) -> DataFrame:
    """Rows per (task, model, reasoning), exact, and per (task, model), at least, against the expected number."""
    task, model, reasoning = F.col("task"), F.col("model"), F.col("reasoning")
    g = df.groupingSets([[task, model, reasoning], [task, model]], task, model, reasoning).agg(
        F.grouping("reasoning").alias("coarse"), F.count("*").alias("n_rows")
    )
    ok = F.when(F.col("coarse") == 1, F.col("n_rows") >= expected).otherwise(F.col("n_rows") == expected)
    return g.select(F.when(F.col("coarse") == 1, "task_model").otherwise("task_model_reasoning").alias("level"), "task", "model", "reasoning", "n_rows", ok.alias("ok"))


def invalid_json_report(df: DataFrame, response: str = "raw_response") -> DataFrame:
    """Groups with at least one response that is not one JSON object, at two levels."""
    task, model, reasoning = F.col("task"), F.col("model"), F.col("reasoning")
    t = df.select("task", "model", "reasoning", (~is_strict_json(response)).cast("int").alias("bad"))
    g = t.groupingSets([[task, model, reasoning], [task, model]], task, model, reasoning).agg(
        F.grouping("reasoning").alias("coarse"), F.count("*").alias("n_rows"), F.sum("bad").alias("n_invalid")
    )
    return g.filter("n_invalid > 0").select(
        F.when(F.col("coarse") == 1, "task_model").otherwise("task_model_reasoning").alias("level"), "task", "model", "reasoning",
        "n_rows", "n_invalid", (F.col("n_invalid") / F.col("n_rows")).alias("frac_invalid"),
    )


def invalid_json_rows(df: DataFrame, response: str = "raw_response") -> DataFrame:
    return df.filter(~is_strict_json(response))


def leaderboard_pivot(df: DataFrame, value: str = "performance", tasks: list[str] = C.TASK_ORDER, ordered: bool = True) -> DataFrame:
    """One line per model and reasoning, one text column per task: percent to one decimal, or whole tokens."""
    wide = df.groupBy("model", "reasoning").pivot("task", tasks).agg(F.avg(value))
    def show(c: str) -> Column:
        v = F.col(f"`{c}`")
        percent = v * 100
        # quarters are the only exact ties at one decimal; they go to the even digit
        percent = F.when(F.rint(percent * 4) == percent * 4, F.bround(percent, 1)).otherwise(percent)
        text = F.rint(v).cast("bigint").cast("string") if value == "tokens" else F.format_string("%.1f", percent)
        return F.when(v.isNull(), "-").otherwise(text).alias(c)
    out = wide.select(
        display_model(F.col("model")).alias("Model"), F.col("reasoning").alias("Reasoning"), *[show(t) for t in tasks],
        _rank(canonical_model(F.col("model")), C.MODEL_ORDER).alias("_m"), canonical_model(F.col("model")).alias("_k"),
        _rank(F.col("reasoning"), C.REASONING_ORDER).alias("_r"),
    )
    if ordered:
        out = out.orderBy("_m", "_k", "_r", "Model", "Reasoning")
    return out.drop("_m", "_k", "_r")


def melt_scores(df: DataFrame, source: str, fixed: tuple[str, ...] = ("Task", "Metric")) -> DataFrame:
    """Wide score table to (Task, Metric, Model, Score); entries that are no number are dropped."""
    models = [c for c in df.columns if c not in fixed]
    texts = df.select(*fixed, *[F.col(f"`{m}`").cast("string").alias(m) for m in models])
    long = texts.unpivot(list(fixed), [F.col(f"`{m}`") for m in models], "Model", "Score")
    return long.withColumn("Score", F.trim("Score").try_cast("double")).withColumn("source", F.lit(source)).filter("Score IS NOT NULL")


def combine_scores(parts: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """Every task from its own source; percent unless perplexity; models without a finite value dropped."""
    long = reduce(DataFrame.unionByName, [df.filter(F.col("Task").isin(tasks)) for df, tasks in parts])
    value = F.when(F.contains(F.lower("Metric"), F.lit("perplexity")), F.col("Score")).otherwise(F.col("Score") * 100)
    long = long.withColumn("ValuePlot", value)
    finite = long.groupBy("Model").agg(F.max((F.abs("ValuePlot") < float("inf")).cast("int")).alias("any")).filter("any = 1")
    return long.join(finite.select("Model"), "Model", "left_semi")


def grid(df: DataFrame, x: str, y: str, xs: list, value: str | None = None) -> DataFrame:
    """Rows by y, columns by x: counts (0 where empty) or the mean of a value."""
    g = df.groupBy(y).pivot(x, xs)
    return g.count().na.fill(0) if value is None else g.agg(F.avg(value))


def value_counts(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """How often each value occurs; difficulty scores are whole numbers of a small range."""
    return df.groupBy(*keys, col).agg(F.count("*").alias("n"))


def describe(df: DataFrame, col: str, keys: list[str] = ()) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles. The deviation comes from central moments, which add up without loss;
    the quartiles are exact (see `prefix.quantiles`), and no task ever holds a group."""
    keys = list(keys)
    c, t = F.col(col).cast("double"), df.filter(F.col(col).isNotNull())
    g = t.groupBy(*keys).agg(
        F.count("*").alias("count"), F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"))
    q = quantiles(value_counts(t, keys, col), col, keys, [0.25, 0.5, 0.75]).toDF(*[f"_{k}" for k in keys], "q25", "q50", "q75")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.lit(True))
    met = g.join(q, same) if keys else g.withColumn("_q", q.select(F.struct("q25", "q50", "q75")).scalar()).select("*", "_q.*")
    return met.select(*keys, "count", "min", "q25", "q50", "q75", "max", "mean", "std")


def difficulty_histogram(df: DataFrame, first: int = 500, col: str = "difficulty_sd", order: str = "row_idx") -> DataFrame:
    """Counts per task and bin for the first rows and for all, on common bins (width 2*IQR*n^(-1/3), at least 1)."""
    t = df.filter(F.col(col).isNotNull())
    all_counts = value_counts(t, ["task"], col).withColumn("subset", F.lit("all"))
    head = head_per_group(t, ["task"], order, first)
    counts = all_counts.unionByName(value_counts(head, ["task"], col).withColumn("subset", F.lit("first")))
    per_value = value_counts(t, [], col)
    quartiles = quantiles(per_value, col, [], [0.25, 0.75]).select(F.col("q1") - F.col("q0")).scalar()
    stats = per_value.agg(
        F.struct(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi"), F.sum("n").cast("double").alias("n"))).scalar()
    b = counts.withColumn("_st", stats).withColumn("_st", F.col("_st").withField("iqr", quartiles))
    width = F.greatest(F.lit(2.0) * F.col("_st.iqr") / F.pow(F.col("_st.n"), F.lit(1.0 / 3.0)), F.lit(1.0))
    b = b.withColumn("n_bins", F.greatest(F.ceil((F.col("_st.hi") - F.col("_st.lo")) / width), F.lit(1)).cast("int"))
    span = F.when(F.col("_st.hi") > F.col("_st.lo"), F.col("_st.hi") - F.col("_st.lo")).otherwise(1.0)
    at = F.floor((F.col(col) - F.col("_st.lo")) * F.col("n_bins") / span)
    b = b.withColumn("bin", F.least(at, F.col("n_bins") - 1).cast("int"))
    g = b.groupBy("task", "subset", "bin").agg(F.sum("n").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("task", "subset")))


# ---- joins ----

def missing_cells(df: DataFrame, tasks: list[str] = C.TASKS) -> DataFrame:
    """Per model and reasoning: tasks present and missing, with the missing ones listed."""
    present = df.groupBy("model", "reasoning").agg(F.collect_set("task").alias("present"))
    gone = F.array_except(F.array(*[F.lit(t) for t in tasks]), F.col("present"))
    return present.select(
        "model", "reasoning", F.size("present").alias("tasks_present"), F.size(gone).alias("tasks_missing"), F.array_join(gone, ";").alias("missing_task_list")
    )


def tokens_vs_perf(df: DataFrame) -> DataFrame:
    """Mean tokens and mean performance per group, over rows with a valid token count.

    Both means come from one aggregation, which is what a full outer join of the two would give.
    """
    return tokens_perf(apply_rules(df, drop_limit=True))


# ---- windows ----

def cumulative_mean(df: DataFrame, keys: list[str] = GROUP, order: str = "row_idx", every: int = 10, value: str = "performance") -> DataFrame:
    """Mean of the first k rows of each group, for every k that is a multiple of `every`."""
    sliced = quantile_slices(df, order)
    t = running_totals(sliced, keys, [order], {"k": F.lit(1).cast("bigint"), "total": F.col(value)})
    return t.filter(F.col("k") % every == 0).select(*keys, "k", (F.col("total") / F.col("k")).alias("mean"))


def difficulty_curve(df: DataFrame, keys: list[str] = GROUP, x: str = "difficulty_sd", y: str = "performance", bins: int = 40,
                     smooth: int = 5, keep_max: bool = True) -> DataFrame:
    """Mean of y per equal bin of x, empty bins left out, smoothed over neighbours.

    The largest x belongs to the last bin; without `keep_max` it falls past it and is lost. The smoother pads with zeros
    and always divides by its width, and is skipped when there are fewer bins than that.
    """
    # sums per value first: rows of one group meet only after this
    per_x = df.groupBy(*keys, x).agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
    w = Window.partitionBy(*keys)
    t = per_x.withColumn("_lo", F.min(x).over(w)).withColumn("_hi", F.max(x).over(w))
    span = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo"))
    at = F.floor((F.col(x) - F.col("_lo")) * bins / span)
    t = t.withColumn("bin", (F.least(at, F.lit(bins - 1)) if keep_max else at).cast("int")).filter(F.col("bin") < bins)
    t = t.groupBy(*keys, "bin").agg((F.sum("_s") / F.sum("_n")).alias("m"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
    half = smooth // 2
    near = Window.partitionBy(*keys).orderBy("bin").rowsBetween(-half, half)
    line = F.when(F.count("*").over(w) >= smooth, F.sum("m").over(near) / smooth).otherwise(F.col("m"))
    center = F.col("_lo") + (F.col("bin") + 0.5) * (F.col("_hi") - F.col("_lo")) / bins
    return t.select(*keys, "bin", center.alias("center"), line.alias("value"))


def head_per_group(df: DataFrame, keys: list[str], order: str = "row_idx", n: int = 500) -> DataFrame:
    """First n rows of each group; every task keeps at most n rows of a group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def tail_examples(df: DataFrame, keys: list[str], order: str = "row_idx", n: int = 10) -> DataFrame:
    """Last n rows of each group, numbered from the end."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("from_end", F.row_number().over(w)).filter(F.col("from_end") <= n)


# ---- evaluation of a run ----

def acc_by_difficulty(df: DataFrame, keys: list[str], acc: str = "acc") -> DataFrame:
    """Per difficulty: accuracy, share of the samples, and the mean sampled difficulty of the group."""
    g = df.groupBy(*keys, "difficulty").agg(F.avg(acc).alias("acc"), F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    g = g.withColumn("share", F.col("n") / F.sum("n").over(w))
    return g.withColumn("mean_difficulty", F.sum(F.col("difficulty") * F.col("n")).over(w) / F.sum("n").over(w))


def sample_rollup(df: DataFrame, sample: str, score: str, threshold: float) -> DataFrame:
    """Several numbers per sample: correct when all are, score is their mean."""
    return df.groupBy(sample).agg(
        F.count("*").alias("n_numbers"), F.bool_and(F.col(score) > threshold).alias("correct"), F.avg(score).alias("score")
    )


def batch_means(df: DataFrame, batch: str, score: str, keys: list[str] = ()) -> DataFrame:
    """Reported accuracy (mean of batch means) beside the mean over rows."""
    per_batch = df.groupBy(*keys, batch).agg(F.avg(score).alias("_m"), F.sum(score).alias("_s"), F.count(score).alias("_n"))
    return per_batch.groupBy(*keys).agg(F.avg("_m").alias("mean_of_batches"), (F.sum("_s") / F.sum("_n")).alias("mean_of_rows"), F.count("*").alias("n_batches"))


def perplexity_by_scope(df: DataFrame, keys: list[str], loss: str = "loss", number: str = "is_number", near: str = "near_number") -> DataFrame:
    """exp(mean loss) over text tokens and over text tokens near numbers, and mean(exp(loss)) over batches."""
    text = ~F.col(number)
    per_batch = df.groupBy(*keys, "batch").agg(
        F.avg(loss).alias("_b"), F.sum(F.when(text, F.col(loss))).alias("_t"), F.count(F.when(text, F.col(loss))).alias("_tn"),
        F.sum(F.when(text & F.col(near), F.col(loss))).alias("_r"), F.count(F.when(text & F.col(near), F.col(loss))).alias("_rn"),
    )
    return per_batch.groupBy(*keys).agg(
        F.avg(F.exp("_b")).alias("perplexity"), F.exp(F.sum("_t") / F.sum("_tn")).alias("text_perplexity"),
        F.exp(F.sum("_r") / F.sum("_rn")).alias("numeric_text_perplexity"),
    )


def task_weights(df: DataFrame, p: float = 1.0, eps: float = 0.01, acc: str = "acc", keys: list[str] = ()) -> DataFrame:
    """Normalised room for improvement: max(1-acc, eps)^(1-p), summing to 1."""
    raw = F.pow(F.greatest(F.lit(1.0) - F.col(acc), F.lit(eps)), F.lit(1.0 - p))
    t = df.withColumn("_w", raw)
    return t.withColumn("weight", F.col("_w") / F.sum("_w").over(Window.partitionBy(*(keys or [F.lit(0)])))).drop("_w")


# Prefixes that name the family of a metric column.
METRIC_FAMILIES = ["val_gen_perplexity", "val_gen_loss", "val_gen_acc", "additional_metrics", "train_loss"]


def metrics_log(df: DataFrame, interval: int, max_step: int | Column | None = None) -> DataFrame:
    """Long log (step, name, value) as interval means by family, dataset and metric.

    Steps after `max_step` are left out. A training loss with no value in an interval counts 0.
    """
    t = df if max_step is None else df.filter(F.col("step") <= max_step)
    family = F.regexp_extract("name", f"^({'|'.join(METRIC_FAMILIES)})_", 1)
    rest = F.regexp_replace("name", f"^(?:{'|'.join(METRIC_FAMILIES)})_", "")
    file = F.regexp_extract(rest, r"^(.*?(?:\.csv\.gz|\.txt))_(.+)$", 1)
    file_metric = F.regexp_extract(rest, r"^.*?(?:\.csv\.gz|\.txt)_(.+)$", 1)
    last = F.regexp_extract(rest, r"^(.*)_([^_]+)$", 1)
    last_metric = F.regexp_extract(rest, r"^.*_([^_]+)$", 1)
    nested = family == "additional_metrics"
    t = t.select(
        F.floor(F.col("step") / interval).cast("bigint").alias("interval"), F.when(family == "", F.col("name")).otherwise(family).alias("family"),
        F.when(nested, F.when(file != "", file).otherwise(last)).when(family != "", rest).otherwise("").alias("dataset"),
        F.when(nested, F.when(file != "", file_metric).otherwise(last_metric)).otherwise("").alias("metric"), "step", "value",
    )
    mean = F.avg("value")
    g = t.groupBy("interval", "family", "dataset", "metric").agg(mean.alias("mean"), F.max("step").alias("last_step"), F.max_by("value", "step").alias("last_value"))
    return g.withColumn("mean", F.when(F.col("family") == "train_loss", F.coalesce("mean", F.lit(0.0))).otherwise(F.col("mean")))


def flatten_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """Nested metric maps as long rows named key_subkey; plain columns keep their name."""
    def rows(c: str, dtype: str) -> Column:
        if not dtype.startswith("map"):
            return F.array(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")))
        name = lambda e: F.concat(F.lit(f"{c}_"), e["key"])
        return F.transform(F.map_entries(c), lambda e: F.struct(name(e).alias("name"), e["value"].cast("double").alias("value")))

    parts = [rows(c, dtype) for c, dtype in df.dtypes if c not in keys]
    return df.select(*keys, F.inline(F.concat(*parts)))


def generalized_means(df: DataFrame, powers: list[float], acc: str = "acc", eps: float = 0.01) -> DataFrame:
    """One row per power: the power mean of the accuracies."""
    named = df.agg(*[M.generalized_mean(F.col(acc), p, eps).alias(f"g{i}") for i, p in enumerate(powers)])
    rows = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.col(f"g{i}").alias("mean")) for i, p in enumerate(powers)])
    return named.select(F.inline(rows))
