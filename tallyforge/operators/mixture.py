"""Task and difficulty mixtures: weights, frontier, interleaved sample order."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.prefix import quantile_slices, ranked, ranked_by_hash, running_totals


# ---- interleaving ----

def _epochs(df: DataFrame, group: list[str], keys: list[str], seed: int) -> DataFrame:
    """Adds `_rn`, the place of a row in the hashed order of its group."""
    return ranked_by_hash(df, group, F.xxhash64(F.lit(seed), *keys), keys, "_rn")


def _equal(group: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)])


def interleave(df: DataFrame, group: list[str], weights: DataFrame, keys: list[str], batch: int, seed: int = 42, total: int | None = None, stop: str = "all") -> DataFrame:
    """Rows of weighted groups in one order with the groups' shares in every batch.

    The i-th row of a group with share r falls due at (i - 0.5) / r; rows go by due time. A group that is used up is repeated in
    a fresh hashed order. The order ends after `total` rows; without a total when every group has been drawn whole, or with
    `stop="first"` as soon as one has. A group without a weight is an error; one of weight 0 is left out.
    Adds `slot` (place in the order), `batch` and `epoch`.
    """
    if stop not in ("all", "first"):
        raise ValueError('stop is "all" or "first"')
    # one row per group, as many as there are sources and difficulty levels
    sums = Window.partitionBy(F.lit(0))
    share = weights.withColumn("_share", F.col("weight") / F.sum("weight").over(sums)).filter("_share > 0").select(*group, "_share")
    t = df
    sizes = t.groupBy(*group).agg(F.count("*").alias("_size"))
    weighted = weights.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)])
    lacking = sizes.join(weighted, _equal(group), "left_anti").select(*group).limit(5).collect()
    if lacking:
        raise ValueError(f"groups without a weight: {', '.join(str(tuple(r)) for r in lacking)}")
    share = share.join(sizes, group)
    if total is None:
        ends = F.col("_size") / F.col("_share")
        share = share.withColumn("_until", (F.max(ends) if stop == "all" else F.min(ends)).over(sums))
    else:
        share = share.withColumn("_until", F.lit(float(total)))
    share = share.withColumn("_times", F.greatest(F.ceil(F.col("_until") * F.col("_share") / F.col("_size")).cast("int"), F.lit(1)))
    share = share.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "_share", "_size", "_until", "_times")
    t = t.join(share, _equal(group)).drop(*[f"_g{i}" for i in range(len(group))])
    t = t.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_times") - 1)))
    t = _epochs(t, [*group, "epoch"], [*keys, "epoch"], seed)
    due = (F.col("epoch") * F.col("_size") + F.col("_rn") - 0.5) / F.col("_share")
    # rounded, so that the last digits of the shares do not decide between equal due times
    t = t.withColumn("_due", F.round(due, 6)).filter(F.col("_due") <= F.round("_until", 6))
    t = ranked(t, [], "_due", "slot", ties=group)
    t = t.withColumn("slot", F.col("slot") - 1).withColumn("batch", F.floor(F.col("slot") / batch))
    t = t if total is None else t.filter(F.col("slot") < total)
    return t.drop("_share", "_size", "_until", "_times", "_rn", "_due")


def mix_sources(df: DataFrame, ratios: dict[str, float], batch: int, keys: list[str], source: str = "source", seed: int = 42, total: int | None = None, stop: str = "all") -> DataFrame:
    """Sources interleaved at fixed ratios; every source needs one."""
    weights = df.sparkSession.createDataFrame(list(ratios.items()), f"{source} string, weight double")
    return interleave(df, [source], weights, keys, batch, seed, total, stop)


def curriculum_weights(task_weights: DataFrame, difficulty_weights: DataFrame, levels: DataFrame) -> DataFrame:
    """Weight of every (task, difficulty): task share times difficulty share.

    A task without difficulty weights is drawn from as a whole, by the rows of its levels (`n` in levels).
    """
    d = difficulty_weights.withColumn("_d", F.col("weight") / F.sum("weight").over(Window.partitionBy("task"))).select("task", "difficulty", "_d")
    has = d.select("task").distinct().withColumn("_has", F.lit(True))
    t = levels.join(has, "task", "left").join(d, ["task", "difficulty"], "left")
    whole = F.col("n") / F.sum("n").over(Window.partitionBy("task"))
    t = t.withColumn("_d", F.when(F.col("_has"), F.coalesce("_d", F.lit(0.0))).otherwise(whole))
    return t.join(task_weights.select("task", F.col("weight").alias("_t")), "task").select("task", "difficulty", (F.col("_t") * F.col("_d")).alias("weight"))


def curriculum_mix(df: DataFrame, task_weights: DataFrame, difficulty_weights: DataFrame, batch: int, keys: list[str], seed: int = 42, total: int | None = None, stop: str = "all") -> DataFrame:
    """Samples in an order that keeps task shares and, inside a task, difficulty shares."""
    levels = df.groupBy("task", "difficulty").agg(F.count("*").alias("n"))
    return interleave(df, ["task", "difficulty"], curriculum_weights(task_weights, difficulty_weights, levels), keys, batch, seed, total, stop)


def level_contexts(ranges: DataFrame, length: int, keys: list[str] = ("task",)) -> DataFrame:
    """(keys, difficulty, first, last): the contexts of `length` tokens that a level is drawn from, first to last without the last.

    `ranges` has the token range (lo, hi) of each level; contexts are cut from the start of each key's stream. A level's contexts
    begin inside it and end a whole context before its end. A level too short for that borrows one from its neighbour: the
    next context, or for the highest level of a key the one before.
    """
    first = F.ceil(F.col("lo") / length)
    last = F.greatest(first, F.floor(F.col("hi") / length) - 1)
    top = F.max("difficulty").over(Window.partitionBy(*keys))
    t = ranges.select(*keys, "difficulty", first.alias("first"), last.alias("last"), (F.col("difficulty") < top).alias("_below"))
    short = F.col("first") == F.col("last")
    return t.select(
        *keys, "difficulty", F.when(short & ~F.col("_below"), F.greatest(F.col("first") - 1, F.lit(0))).otherwise(F.col("first")).alias("first"),
        (F.col("last") + F.when(short & F.col("_below"), 1).otherwise(0)).alias("last"), short.alias("borrowed"))


def contexts_of_levels(levels: DataFrame, keys: list[str] = ("task",)) -> DataFrame:
    """(keys, difficulty, context_idx): every context a level may be drawn from; a context may stand in two levels."""
    some = levels.where("first < last")
    return some.select(*keys, "difficulty", F.explode(F.sequence("first", F.col("last") - 1)).alias("context_idx"))


def missing_difficulties(required: DataFrame, available: DataFrame) -> DataFrame:
    """Wanted (task, difficulty) pairs that the data does not have."""
    return required.select("task", "difficulty").distinct().join(available.select("task", "difficulty").distinct(), ["task", "difficulty"], "left_anti")


# ---- history ----

def recent_performance(history: DataFrame, k: int = 5, keep: int = 10, order: str = "step") -> DataFrame:
    """Mean of the last k evaluations per task and difficulty, after each evaluation; k is at most the kept history.

    Every evaluation is sent to the k ranks it counts for, so a long history is never one task's work.
    """
    k = min(k, keep)
    t = ranked(history, ["task", "difficulty"], order, "_rn")
    t = t.withColumn("_off", F.explode(F.array(*[F.lit(i) for i in range(k)]))).withColumn("_at", F.col("_rn") + F.col("_off"))
    own = F.max(F.when(F.col("_off") == 0, F.struct(*history.columns)))
    g = t.groupBy("task", "difficulty", "_at").agg(F.avg("acc").alias("recent"), own.alias("_own"))
    return g.filter("_own IS NOT NULL").select("_own.*", "recent")


def latest_performance(history: DataFrame, k: int = 5, keep: int = 10, order: str = "step") -> DataFrame:
    """Mean of the last k evaluations per task and difficulty, and their number (at most `keep`)."""
    k = min(k, keep)
    w = Window.partitionBy("task", "difficulty").orderBy(F.col(order).desc())
    last = history.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= keep)
    return last.groupBy("task", "difficulty").agg(F.avg(F.when(F.col("_rn") <= k, F.col("acc"))).alias("recent"), F.count("*").alias("n_evals"))


def threshold_multiplier(difficulty: Column, max_difficulty: Column, progress: Column) -> Column:
    """Share of the advancement threshold that is left: easy levels relax first, the hardest last."""
    start = F.when(max_difficulty > 0, difficulty / max_difficulty).otherwise(0.0)
    left = F.lit(1.0) - (progress - start) / 0.5
    return F.when(max_difficulty <= 0, 1.0).when(progress <= start, 1.0).when(progress <= start + 0.5, left).otherwise(0.0)


def frontier_advance(
    history: DataFrame, levels: DataFrame, frontier: DataFrame, threshold: float, window: int = 3, k: int = 3, step_fraction: float = 0.05,
    progress: float = 0.0, order: str = "step",
) -> DataFrame:
    """Next frontier per task: advances when every level of the window at the frontier is mastered.

    `levels` lists (task, difficulty); `frontier` has (task, frontier). A missing level of the window is
    skipped, a level without history counts 0, and a task with fewer than k evaluations of all its levels stays.
    """
    facts = levels.groupBy("task").agg(F.min("difficulty").alias("lo"), F.max("difficulty").alias("hi"), F.count("*").alias("n_levels"))
    t = levels.join(frontier, "task").join(facts, "task").join(latest_performance(history, k, order=order), ["task", "difficulty"], "left")
    bar = F.lit(threshold) * threshold_multiplier(F.col("difficulty").cast("double"), F.col("hi").cast("double"), F.lit(progress))
    in_window = (F.col("difficulty") <= F.col("frontier")) & (F.col("difficulty") >= F.greatest(F.col("lo"), F.col("frontier") - window + 1))
    step = F.greatest(F.lit(1), F.rint(F.col("n_levels") * step_fraction).cast("int"))
    ahead = (F.col("difficulty") > F.col("frontier")) & (F.col("difficulty") <= F.least(F.col("frontier") + step, F.col("hi")))
    good = F.coalesce("recent", F.lit(0.0)) >= bar
    g = t.groupBy("task").agg(
        F.first("frontier").alias("frontier"), F.first("hi").alias("hi"), F.bool_and(F.when(in_window, good)).alias("mastered"), F.max(F.when(ahead, F.col("difficulty"))).alias("_next"),
        F.sum("n_evals").alias("evals"),
    )
    mastered = F.coalesce("mastered", F.lit(False)) & (F.coalesce("evals", F.lit(0)) >= k)
    return g.select(
        "task", "frontier", mastered.alias("mastered"), F.when(mastered, F.coalesce("_next", "frontier")).otherwise(F.col("frontier")).alias("new_frontier"),
        (mastered & (F.col("frontier") >= F.col("hi"))).alias("finished"),
    )


def endgame_switch(tasks: DataFrame, finished: DataFrame, standby_fraction: float = 0.1) -> DataFrame:
    """Finished tasks with an endgame successor go on standby; their ratio is split between the two.

    `tasks` has (idx, task, type, ratio); a finished task without a successor stops sampling by difficulty.
    """
    w = Window.partitionBy(F.lit(0)).orderBy("idx")
    t = tasks.join(finished.select("task", "finished"), "task", "left").withColumn("finished", F.coalesce("finished", F.lit(False)))
    t = t.withColumn("_next", F.lead("type").over(w)).withColumn("_before", F.lag("type").over(w)).withColumn("_done", F.lag("finished").over(w)).withColumn("_ratio", F.lag("ratio").over(w))
    leaves = (F.col("type") == "curriculum") & F.col("finished") & (F.col("_next") == "endgame")
    enters = (F.col("type") == "endgame") & (F.col("_before") == "curriculum") & F.col("_done")
    leaves, enters = F.coalesce(leaves, F.lit(False)), F.coalesce(enters, F.lit(False))
    ratio = F.when(leaves, F.col("ratio") * standby_fraction).when(enters, F.col("_ratio") * (1 - standby_fraction)).otherwise(F.col("ratio"))
    kind = F.when(leaves, "standby").when(enters, "standard").otherwise(F.col("type"))
    sampling = ~((F.col("type") == "curriculum") & F.col("finished") & ~leaves)
    return t.select("idx", "task", kind.alias("type"), ratio.alias("ratio"), sampling.alias("difficulty_sampling"))


def difficulty_ratios(history: DataFrame, levels: DataFrame, frontier: DataFrame, p: float = 1.0, k: int = 5, floor: float = 0.01, preview: float = 0.0,
                      decay: float = 0.5, eps: float = 0.01, order: str = "step") -> DataFrame:
    """Share of every level: by room for improvement up to the frontier (with a floor), by decay beyond it."""
    t = levels.join(frontier, "task").join(latest_performance(history, k, order=order), ["task", "difficulty"], "left")
    w = Window.partitionBy("task")
    known = F.col("difficulty") <= F.col("frontier")
    raw = F.when(known, F.pow(F.greatest(F.lit(1.0) - F.coalesce("recent", F.lit(0.0)), F.lit(eps)), F.lit(1.0 - p)))
    t = t.withColumn("_r", raw).withColumn("_r", F.col("_r") / F.sum("_r").over(w))
    t = t.withColumn("_r", F.when(known, F.greatest(F.col("_r"), F.lit(floor) / F.count(F.when(known, 1)).over(w))))
    t = t.withColumn("_r", F.col("_r") / F.sum("_r").over(w))
    if preview <= 0:
        return t.filter(known).select("task", "difficulty", F.col("_r").alias("ratio"))
    t = t.withColumn("_v", F.when(~known, F.pow(F.lit(decay), (F.col("difficulty") - F.col("frontier")).cast("double"))))
    t = t.withColumn("_v", F.col("_v") / F.sum("_v").over(w)).withColumn("_any", F.count("_v").over(w) > 0)
    ratio = F.when(~F.col("_any"), F.col("_r")).when(known, F.col("_r") * (1 - preview)).otherwise(F.col("_v") * preview)
    return t.select("task", "difficulty", ratio.alias("ratio"))


# ---- weights ----

def capped_weights(df: DataFrame, weight: str = "weight", cap: str = "cap", keys: list[str] = ()) -> DataFrame:
    """Weights scaled to sum 1 with no weight above its cap; adds `capped`.

    Sorted by cap/weight, the entries at their cap are a prefix: entry i is capped when its cap is below
    its share of the mass the earlier caps leave. The table has one row per task.
    """
    by = list(keys) or [F.lit(0)]
    order = Window.partitionBy(*by).orderBy((F.col(cap) / F.col(weight)).asc(), cap)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    t = df.withColumn("_sum", F.sum(weight).over(Window.partitionBy(*by)))
    t = t.withColumn("_left", F.lit(1.0) - F.coalesce(F.sum(cap).over(before), F.lit(0.0)))
    t = t.withColumn("_mass", F.col("_sum") - F.coalesce(F.sum(weight).over(before), F.lit(0.0)))
    t = t.withColumn("_full", (F.col("_left") > 0) & (F.col(weight) * F.col("_left") > F.col(cap) * F.col("_mass")))
    # mass and room after the last entry at its cap
    w = Window.partitionBy(*by)
    fixed = F.coalesce(F.sum(F.when(F.col("_full"), F.col(cap))).over(w), F.lit(0.0))
    free = F.sum(F.when(~F.col("_full"), F.col(weight))).over(w)
    room = F.lit(1.0) - fixed
    value = F.when(F.col("_full"), F.col(cap)).when(room <= 0, 0.0).otherwise(F.col(weight) * room / free)
    return t.withColumn("capped", value).drop("_sum", "_left", "_mass", "_full")


def blend(df: DataFrame, old: str, new: str, momentum: float, name: str = "ratio") -> DataFrame:
    return df.withColumn(name, F.lit(momentum) * F.col(old) + F.lit(1 - momentum) * F.col(new))


def forward_fill(df: DataFrame, col: str, order: str, keys: list[str] = ()) -> DataFrame:
    """Missing, infinite and not-a-number entries take the last valid value before them.

    Rows are cut into slices along the order; each slice hands its last valid value on to the next ones.
    """
    keys = list(keys)
    v = F.col(col)
    valid = F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)
    t = quantile_slices(df, order).withColumn("_valid", valid)
    ends = t.groupBy(*keys, "_slice").agg(F.max_by("_valid", F.when(F.col("_valid").isNotNull(), F.col(order))).alias("_end"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_slice").alias("_ks"), F.last("_end", ignorenulls=True).over(before).alias("_carried")
    )
    match = F.col("_slice") == F.col("_ks")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = t.withColumn("_local", F.last("_valid", ignorenulls=True).over(inside))
    return local.join(carried, match).withColumn(col, F.coalesce("_local", "_carried")).select(*df.columns)


def loss_weights(df: DataFrame, order: str = "idx", keys: list[str] = (), magnitude: float | None = None) -> DataFrame:
    """Adds `new_weight` that brings every task's loss to that of the last task, or to a fixed magnitude.

    `df` has loss, weight, ratio and (without magnitude) `scale`, the warm-up scale of a task.
    """
    t = df.withColumn("_descaled", F.col("loss") / (F.col("weight") * F.col("ratio")))
    by = list(keys) or [F.lit(0)]
    safe = lambda a, b: F.when(b != 0, a / b)
    if magnitude is not None:
        t = t.withColumn("new_weight", safe(F.lit(magnitude), F.col("_descaled")))
    else:
        last = Window.partitionBy(*by)
        at = F.max(order).over(last)
        ref = F.max(F.when(F.col(order) == at, F.col("scale") * F.col("_descaled"))).over(last)
        t = t.withColumn("_ref", ref).withColumn("new_weight", F.when(F.col(order) == at, F.col("weight")).otherwise(safe(F.col("_ref"), F.col("_descaled")))).drop("_ref")
    return forward_fill(t, "new_weight", order, keys).drop("_descaled")


def standby_split(df: DataFrame, fraction: float = 0.1, order: str = "idx", keys: list[str] = ()) -> DataFrame:
    """Ratios with the standby tasks before endgame tasks included: a task right after one gives it a fraction."""
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(order)
    t = df.withColumn("_gives", F.coalesce(F.lag("type").over(w) == "standby", F.lit(False)))
    t = t.withColumn("_takes", F.lead(F.col("ratio")).over(w))
    ratio = F.when(F.col("type") == "standby", F.col("_takes") * fraction).when(F.col("_gives"), F.col("ratio") * (1 - fraction)).otherwise(F.col("ratio"))
    return t.withColumn("true_ratio", ratio).drop("_gives", "_takes")


def interpolate_steps(df: DataFrame, col: str, order: str = "step", keys: list[str] = ()) -> DataFrame:
    """Known values at some steps, straight lines between them; steps before the first take its value.

    Each stretch between two known steps is filled on its own, so no task holds a whole series.
    """
    by = list(keys)
    known = df.filter(F.col(col).isNotNull()).select(*by, F.col(order).alias("_s"), F.col(col).alias("_v"))
    rank = ranked(known, by, "_s", "_rn")
    before = rank.select(*by, F.col("_s").alias("_s0"), F.col("_v").alias("_v0"), (F.col("_rn") + 1).alias("_rn"))
    parts = rank.join(before, [*by, "_rn"], "left")
    low = F.when(F.col("_s0").isNull(), F.least(F.lit(0), F.col("_s"))).otherwise(F.col("_s0") + 1)
    t = parts.withColumn(order, F.explode(F.sequence(low, F.col("_s"))))
    line = F.col("_v0") + (F.col("_v") - F.col("_v0")) * (F.col(order) - F.col("_s0")) / (F.col("_s") - F.col("_s0"))
    return t.select(*by, order, F.when(F.col("_s0").isNull(), F.col("_v")).when(F.col(order) == F.col("_s"), F.col("_v")).otherwise(line).alias(col))
