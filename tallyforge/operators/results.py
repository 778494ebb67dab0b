"""Keeping result sets: merge of two runs, canonical order, resume, upsert, cost."""
from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge import constants as C
from tallyforge.functions import answers as A
from tallyforge.operators.prefix import quantile_slices, running_totals
from tallyforge.session import materialized

RESPONSE = "raw_response"


def is_empty(response: Column) -> Column:
    return response.isNull() | response.rlike(r"^\s*$")


def merge_runs(h1: DataFrame, h2: DataFrame, idx: list[str], tokens: str = "tokens") -> tuple[DataFrame, DataFrame]:
    """Row by row: run 1 unless its response is empty, else run 2; rows empty in both as an extra table.

    Both empty at the output limit gives a fixed text. A row that only one run has is an error.
    """
    a = h1.select(F.struct("*").alias("a"), *[F.col(k).alias(f"_a{i}") for i, k in enumerate(idx)])
    b = h2.select(F.struct("*").alias("b"), *[F.col(k).alias(f"_b{i}") for i, k in enumerate(idx)])
    match = F.lit(True)
    for i in range(len(idx)):
        match = match & (F.col(f"_a{i}") == F.col(f"_b{i}"))
    both = a.join(b, match, "full")
    whole = F.col("_a0").isNotNull() & F.col("_b0").isNotNull()
    both = both.withColumn("_ok", F.when(whole, True).otherwise(F.raise_error(F.lit("row count mismatch between the two runs")))).filter("_ok")
    no_a, no_b = is_empty(F.col(f"a.{RESPONSE}")), is_empty(F.col(f"b.{RESPONSE}"))
    at_limit = (F.col(f"a.{tokens}").try_cast("bigint") == C.TOKEN_LIMIT) & (F.col(f"b.{tokens}").try_cast("bigint") == C.TOKEN_LIMIT)
    at_limit = F.coalesce(at_limit, F.lit(False))
    take_b = no_a & ~no_b
    columns = h1.columns + [c for c in h2.columns if c not in h1.columns]

    def pick(c: str) -> Column:
        if c == RESPONSE:
            value = F.when(no_a & no_b & at_limit, C.TOKEN_LIMIT_TEXT).when(take_b, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
        elif c not in h1.columns:
            value = F.col(f"b.`{c}`")
        elif c not in h2.columns:
            value = F.when(~take_b, F.col(f"a.`{c}`"))
        else:
            value = F.when(take_b, F.col(f"b.`{c}`")).otherwise(F.col(f"a.`{c}`"))
        return value.alias(c)

    rows = both.select(*[pick(c) for c in columns])
    warnings = both.filter(no_a & no_b & ~at_limit).select(
        *[F.col(f"_a{i}").alias(k) for i, k in enumerate(idx)], F.col(f"a.{tokens}").alias("tokens_h1"), F.col(f"b.{tokens}").alias("tokens_h2")
    )
    return rows, warnings


def canonical_prefix(
    results: DataFrame, canonical: DataFrame, keys: list[str], prompt: str = "text_prompt", idx: str = "row_idx", pos: str = "pos",
    copy: list[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Results in canonical order, cut at the first canonical prompt without a result.

    The first row of a prompt wins. `copy` names columns to take over from the canonical rows.
    The report has one row per file key: duplicates, first gap, entries cut off, and whether anything changed.
    """
    trimmed = lambda c: F.trim(F.col(c))
    firsts = results.groupBy(*keys, trimmed(prompt).alias("_p")).agg(
        F.min_by(F.struct(*results.columns), idx).alias("row"), F.count("*").alias("_times")
    )
    files = results.groupBy(*keys).agg(F.count("*").alias("n_results"))
    shared = [k for k in keys if k in canonical.columns]
    order = canonical.select(*shared, trimmed(prompt).alias("_p"), F.col(pos).alias("pos"), *[F.col(c).alias(f"_c_{c}") for c in copy])
    # every file is held against the whole canonical list of its key; the list of files is small
    if not shared:
        raise ValueError("results and canonical rows need a common key, such as the task")
    wanted = order.join(files, shared)
    found = wanted.join(firsts, [*keys, "_p"], "left")
    cut = found.groupBy(*keys).agg(
        F.min(F.when(F.col("row").isNull(), F.col("pos"))).alias("cut"), F.count("*").alias("n_canonical"), F.first("n_results").alias("n_results")
    )
    kept = found.join(cut.select(*keys, "cut"), keys).filter(F.col("row").isNotNull() & (F.col("cut").isNull() | (F.col("pos") < F.col("cut"))))
    value = lambda c: F.col(f"_c_{c}").alias(c) if c in copy else F.col(f"row.`{c}`").alias(c)
    rows = kept.select("pos", *[value(c) for c in results.columns])
    replaced = F.lit(False)
    for c in copy:
        replaced = replaced | ~F.col(f"_c_{c}").eqNullSafe(F.col(f"row.`{c}`"))
    moved = kept.groupBy(*keys).agg(
        F.count("*").alias("n_kept"), F.max((replaced | (F.col(f"row.`{idx}`") != F.col("pos"))).cast("int")).alias("_moved")
    )
    doubles = firsts.groupBy(*keys).agg(
        F.sum((F.col("_times") > 1).cast("bigint")).alias("duplicate_prompts"), F.sum(F.col("_times") - 1).alias("duplicate_rows")
    )
    report = cut.join(moved, keys, "left").join(doubles, keys, "left").select(
        *keys, F.coalesce("n_kept", F.lit(0)).alias("n_kept"), "duplicate_prompts", "duplicate_rows", F.col("cut").alias("first_missing"),
        (F.col("n_canonical") - F.coalesce("n_kept", F.lit(0))).alias("n_cut"),
        ((F.coalesce("n_kept", F.lit(0)) != F.col("n_results")) | (F.coalesce("_moved", F.lit(0)) == 1)).alias("changed"),
    )
    return rows, report


def resume_worklist(inputs: DataFrame, results: DataFrame, limit: int | Column | None = None, prompt: str = "text_prompt", idx: str = "row_idx") -> DataFrame:
    """Inputs still to be asked: those answered with nothing first, then those never asked.

    With a limit, as many as are missing to it after the prompts already answered. The results are read once: what is known of a
    prompt meets the inputs in one join, and the work found is written before it is ranked.
    """
    empty = is_empty(F.col(RESPONSE))
    known = results.groupBy(F.col(prompt).alias("_p")).agg(F.max(empty).alias("_again"), F.max(~empty).alias("_answered"))
    if limit is not None:
        known = materialized(known, "prompts-known")  # read for the join and for the number of answers
    kind = F.when(F.col("_again"), 0).when(F.col("_again").isNull(), 1)
    work = inputs.join(known, F.col(prompt) == F.col("_p"), "left").withColumn("kind", kind).where("kind is not null").drop("_p", "_again", "_answered")
    if limit is not None:
        sliced = quantile_slices(materialized(work, "worklist"), idx).withColumn("_slice", F.struct("kind", "_slice"))
        ranked = running_totals(sliced, [], ["kind", idx], {"_rn": F.lit(1).cast("bigint")})
        room = known.agg(F.count_if(F.col("_answered"))).scalar()
        work = ranked.withColumn("_room", (F.lit(limit) if isinstance(limit, int) else limit) - room).filter(F.col("_rn") <= F.col("_room")).drop("_rn", "_room")
    return work.withColumn("kind", F.when(F.col("kind") == 0, "retry").otherwise("new"))


def upsert_results(existing: DataFrame, updates: DataFrame, key: str = "text_prompt", idx: str = "row_idx") -> DataFrame:
    """The k-th update of a prompt replaces the k-th empty row of that prompt; other updates are appended.

    Updates without a prompt are always appended. `upd_idx` is the row number of the update that was used.
    """
    columns = existing.columns + [c for c in updates.columns if c not in existing.columns]
    empty = is_empty(F.col(RESPONSE))

    def numbered(df: DataFrame) -> DataFrame:
        return running_totals(quantile_slices(df, idx), [key], [idx], {"_k": F.lit(1).cast("bigint")})

    holes = numbered(existing.filter(empty & F.col(key).isNotNull() & (F.col(key) != "")))
    usable = F.col(key).isNotNull() & (F.col(key) != "")
    new = numbered(updates.filter(usable))
    a = holes.select(F.struct(*existing.columns).alias("a"), F.col(key).alias("_ka"), F.col("_k").alias("_na"))
    b = new.select(F.struct(*updates.columns).alias("b"), F.col(key).alias("_kb"), F.col("_k").alias("_nb"))
    paired = a.join(b, (F.col("_ka") == F.col("_kb")) & (F.col("_na") == F.col("_nb")), "full")

    def merged(c: str) -> Column:
        if c == idx:
            return F.col(f"a.`{c}`").alias(c)
        old = F.col(f"a.`{c}`") if c in existing.columns else F.lit(None)
        put = F.col(f"b.`{c}`") if c in updates.columns else F.lit(None)
        return F.when(F.col("_kb").isNotNull(), put).otherwise(old).alias(c)

    changed = paired.select(*[merged(c) for c in columns], F.col(f"b.`{idx}`").alias("upd_idx"))
    blank = updates.filter(~usable | F.col(key).isNull()).withColumn("upd_idx", F.col(idx)).withColumn(idx, F.lit(None).cast(existing.schema[idx].dataType))
    kept = existing.filter(~(empty & F.col(key).isNotNull() & (F.col(key) != ""))).withColumn("upd_idx", F.lit(None).cast(updates.schema[idx].dataType))
    return kept.unionByName(changed, allowMissingColumns=True).unionByName(blank, allowMissingColumns=True)


def answer_mismatch(df: DataFrame, canonical: DataFrame, keys: list[str], n: int | None = None, idx: str = "row_idx", shown: int = 5, task: str = "task") -> DataFrame:
    """Per file: rows (with `n`, among the first n) whose answer differs from the canonical one of their task, and the first few positions.

    Row numbers begin anew in every file, and every task has its own canonical list.
    """
    asked = F.lit(True) if n is None else F.col(idx) < n
    ours = df.filter(asked).select(*keys, F.col(task).alias("_t"), F.col(idx).alias("_i"), F.trim("answer").alias("_a"))
    theirs = canonical.filter(asked).select(F.col(task).alias("_t"), F.col(idx).alias("_i"), F.trim("answer").alias("_b"))
    wrong = ours.join(theirs, ["_t", "_i"]).filter(F.col("_a") != F.col("_b"))
    total = wrong.groupBy(*keys).agg(F.count("*").alias("n_mismatches"))
    w = Window.partitionBy(*keys).orderBy("_i")
    first = wrong.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= shown)
    first = first.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list("_i")), ",").alias("first_positions"))
    return total.join(first, keys)


def new_cost(df: DataFrame, keys: list[str], rates: dict[str, tuple[float, float]] = C.TOKEN_RATES, model: str = "model") -> DataFrame:
    """Cost of the rows without a recorded cost, by price per token, and rows at the output limit; unpriced models are left out."""
    prompt_rate = completion_rate = None
    for part, (p, c) in rates.items():
        hit = F.contains(F.lower(F.col(model)), F.lit(part))
        prompt_rate = F.when(hit, p) if prompt_rate is None else prompt_rate.when(hit, p)
        completion_rate = F.when(hit, c) if completion_rate is None else completion_rate.when(hit, c)
    t = df.withColumn("_pr", prompt_rate).withColumn("_cr", completion_rate).filter(F.col("_pr").isNotNull())
    number = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(0))
    cost = F.when(F.col("cost").isNull(), number("prompt_tokens") * F.col("_pr") + number("completion_tokens") * F.col("_cr")).otherwise(0.0)
    return t.groupBy(*keys).agg(F.sum(cost).alias("costs"), F.count_if(F.col("completion_tokens") == C.TOKEN_LIMIT).alias("MAX_TOKENS"))


def cost_by_model(df: DataFrame) -> DataFrame:
    """Total cost and tokens by model and reasoning, dearest first."""
    g = df.groupBy("model", "reasoning").agg(F.sum("cost").alias("sum_cost"), F.sum("tokens").alias("sum_tokens"))
    return g.orderBy(F.col("sum_cost").desc(), "model", "reasoning")


def system_message(task: Column) -> Column:
    out = F.when(task == "Interval", C.SYSTEM_MESSAGES["Interval"]).when(task == "Sorting", C.SYSTEM_MESSAGES["Sorting"])
    return out.when(task == "MinMax", C.SYSTEM_MESSAGES["MinMax"]).otherwise(C.SYSTEM_MESSAGES[""])


def response_schema(task: Column, strict: bool = True) -> Column:
    """JSON schema of the wanted answer; the strict form forbids other fields."""
    answer = F.when(task == "Interval", C.ANSWER_SCHEMAS["Interval"]).when(task == "Sorting", C.ANSWER_SCHEMAS["Sorting"]).otherwise(C.ANSWER_SCHEMAS[""])
    body = F.concat(F.lit('{"type": "object", "properties": {"answer": '), answer, F.lit('}, "required": ["answer"]'))
    if not strict:
        return F.concat(body, F.lit("}"))
    head = '{"type": "json_schema", "json_schema": {"name": "answer_schema", "strict": true, "schema": '
    return F.concat(F.lit(head), body, F.lit(', "additionalProperties": false}}}'))


def schema_violation(response: Column | str, task: Column | str) -> Column:
    """How a response breaks the strict schema of its task (see `answers.schema_violation`); null for a response that keeps to it."""
    kinds = {name: {"type": "object", "properties": {"answer": json.loads(a)}, "required": ["answer"], "additionalProperties": False} for name, a in C.ANSWER_SCHEMAS.items()}
    task = F.col(task) if isinstance(task, str) else task
    out = None
    for name, schema in kinds.items():
        if name:
            found = A.schema_violation(response, schema)
            out = F.when(task == name, found) if out is None else out.when(task == name, found)
    return out.otherwise(A.schema_violation(response, kinds[""]))


def chat_requests(df: DataFrame, few_shot: int = 0, idx: str = "row_idx") -> DataFrame:
    """Adds the chat messages of each row: system, the first `few_shot` rows of its task (all, if there are fewer) as examples, user."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    t = df
    shots = F.array().cast("array<struct<role:string,content:string>>")
    if few_shot:
        w = Window.partitionBy("task").orderBy(idx)
        first = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= few_shot)
        pair = F.array(turn("user", F.col("text_prompt")), turn("assistant", F.concat(F.lit('{"answer": '), F.col("answer"), F.lit("}"))))
        # a handful of rows per task
        shown = first.groupBy("task").agg(F.sort_array(F.collect_list(F.struct("_rn", pair.alias("turns")))).alias("_shots"))
        t = df.join(shown, "task", "left")
        shots = F.coalesce(F.flatten(F.transform("_shots", lambda s: s["turns"])), shots)
    messages = F.concat(F.array(turn("system", system_message(F.col("task")))), shots, F.array(turn("user", F.col("text_prompt"))))
    return t.withColumn("messages", messages).drop("_shots")
