"""Prompts, answers and the published form of arithmetic problems."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge import constants as C
from tallyforge.functions.text import _col

PUBLISHED = ["prompt", "text_prompt", "answer", "difficulty", "difficulty_sd"]


def coin(seed: int, *keys: str | Column) -> Column:
    """0 or 1 from a hash of the keys, the same for any partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(2)).cast("int")


def _question(left: Column, sign: Column, right: Column) -> Column:
    return F.concat(F.lit("What is "), left, F.lit(" "), sign, F.lit(" "), right, F.lit("?"))


def arithmetic_prompts(df: DataFrame, sign: Column | str, answer: Column | str, num1: str = "num1", num2: str = "num2") -> DataFrame:
    """`a op b` and the question for it."""
    sign = F.lit(sign) if isinstance(sign, str) else sign
    a, b = F.col(num1), F.col(num2)
    return (
        df.withColumn("prompt", F.concat(a, F.lit(" "), sign, F.lit(" "), b))
        .withColumn("text_prompt", _question(a, sign, b)).withColumn("answer", _col(answer))
    )


def compare_prompts(df: DataFrame, less: Column, spelled: Column) -> DataFrame:
    """`a < b` or `a > b`, the sign spelled out on request, with a boolean answer."""
    a, b = F.col("num1"), F.col("num2")
    sign = F.when(less, "<").otherwise(">")
    words = F.when(spelled, F.when(less, "less than").otherwise("greater than")).otherwise(sign)
    x, y = a.try_cast("double"), b.try_cast("double")
    return (
        df.withColumn("operator", sign).withColumn("prompt", F.concat(a, F.lit(" "), sign, F.lit(" "), b))
        .withColumn("text_prompt", F.concat(F.lit("Is "), a, F.lit(" "), words, F.lit(" "), b, F.lit("?")))
        .withColumn("answer", F.when(less, x < y).otherwise(x > y))
    )


def _listing(numbers: Column) -> Column:
    return F.array_join(numbers, ", ")


def minmax_prompts(df: DataFrame, smallest: Column, numbers: str = "list1") -> DataFrame:
    """Minimum or maximum of a list; answer and difficulties follow the choice."""
    listed = _listing(F.col(numbers))
    word = F.when(smallest, "minimum").otherwise("maximum")
    out = (
        df.withColumn("operator", word).withColumn("prompt", F.concat(F.when(smallest, "<|min|>").otherwise("<|max|>"), listed))
        .withColumn("text_prompt", F.concat(F.lit("What is the "), word, F.lit(" of the list ["), listed, F.lit("]?")))
        .withColumn("answer", F.when(smallest, F.col("minimum")).otherwise(F.col("maximum")))
    )
    for c in ("difficulty", "difficulty_sd"):
        if f"minimum_{c}" in df.columns:
            out = out.withColumn(c, F.when(smallest, F.col(f"minimum_{c}")).otherwise(F.col(f"maximum_{c}")))
    return out


def sort_prompts(df: DataFrame, ascending: Column, numbers: str = "list1") -> DataFrame:
    listed = _listing(F.col(numbers))
    word = F.when(ascending, "asc").otherwise("desc")
    return (
        df.withColumn("operator", word).withColumn("prompt", F.concat(F.lit("<|"), word, F.lit("|>"), listed))
        .withColumn("text_prompt", F.concat(F.lit("Sort the list ["), listed, F.lit("] in "), word, F.lit("ending order.")))
        .withColumn("answer", _listing(F.when(ascending, F.col("asc")).otherwise(F.col("desc"))))
    )


def interval_prompts(df: DataFrame, numbers: str = "list1", ref: str = "ref", position: str = "position") -> DataFrame:
    """Which of the lettered intervals between the sorted numbers holds the reference value."""
    labels = F.array(*[F.lit(v) for v in C.INTERVAL_LABELS])
    n, values, x = F.size(numbers), F.col(numbers), F.col(ref)
    between = F.transform(
        F.slice(values, 2, F.greatest(n - 1, F.lit(0))),
        lambda v, i: F.concat(F.get(labels, i + 1), F.lit(": "), F.get(values, i), F.lit(" <= x < "), v, F.lit(",")),
    )
    text = F.concat(
        F.lit("What interval does x="), x, F.lit(" belong to? A: x < "), values[0], F.lit(", "),
        F.array_join(F.array_append(between, F.concat(F.get(labels, n), F.lit(": "), F.element_at(values, -1), F.lit(" <= x"))), " "),
    )
    marks = F.transform(values, lambda v, i: F.concat(F.get(labels, i), F.lit(" "), v))
    return (
        df.withColumn("prompt", F.concat(F.lit("<|intva|>"), x, F.lit(": "), F.array_join(F.array_append(marks, F.get(labels, n)), " ")))
        .withColumn("text_prompt", text).withColumn("answer", F.get(labels, F.col(position)))
    )


def list_stat_prompts(df: DataFrame, word: str, numbers: str = "list1") -> DataFrame:
    """Mean or std of a list; the answer column has the name of the statistic."""
    listed = _listing(F.col(numbers))
    return (
        df.withColumn("prompt", F.concat(F.lit(f"<|{word}|>"), listed))
        .withColumn("text_prompt", F.concat(F.lit(f"What is the {word} of the list ["), listed, F.lit("]?"))).withColumn("answer", F.col(word))
    )


def repeat_prompts(df: DataFrame, num: str = "num1") -> DataFrame:
    n = F.col(num)
    return (
        df.withColumn("prompt", F.concat(F.lit("<|repeat|>"), n))
        .withColumn("text_prompt", F.concat(F.lit("Repeat the number "), n, F.lit("."))).withColumn("answer", n)
    )


def digit_prompts(df: DataFrame, num: str = "num1", place: str = "digit_pos", digit: str = "digit") -> DataFrame:
    n, p = F.col(num), F.col(place).cast("string")
    return (
        df.withColumn("prompt", F.concat(F.lit("<|char|>"), p, F.lit(" "), n))
        .withColumn("text_prompt", F.concat(F.lit("What is the "), p, F.lit(". digit of "), n, F.lit("?"))).withColumn("answer", F.col(digit))
    )


def to_prompts(df: DataFrame, task: str, seed: int = 42, key: list[str] = ()) -> DataFrame:
    """Prompts of one task; choices between two forms come from a hash of the problem."""
    keys = list(key) or [c for c in ("num1", "num2", "list1", "ref") if c in df.columns]
    first = coin(seed, *keys) == 0
    builders = {
        "Addition": lambda: arithmetic_prompts(df, F.col("operator"), "sum"),
        "Multiplication": lambda: arithmetic_prompts(df, "*", "prod"),
        "DivM": lambda: arithmetic_prompts(df, "/", "quot"),
        "Division": lambda: arithmetic_prompts(df, "/", "quot"),
        "Exponentiation": lambda: arithmetic_prompts(df, "^", "exp"),
        "MinMax": lambda: minmax_prompts(df, first),
        "Sorting": lambda: sort_prompts(df, first),
        "Interval": lambda: interval_prompts(df),
        "Mean": lambda: list_stat_prompts(df, "mean"),
        "Std": lambda: list_stat_prompts(df, "std"),
        "Compare": lambda: compare_prompts(df, first, coin(seed + 1, *keys) == 0),
        "Repeat": lambda: repeat_prompts(df),
        "Digit": lambda: digit_prompts(df),
    }
    if task not in builders:
        raise ValueError(f"unknown task: {task}")
    return builders[task]()


def publish(df: DataFrame, split: str, digits: str = "decimal_uniform", verbose: bool = False) -> DataFrame:
    """The published columns; the test split is sorted by the difficulty its digit distribution goes by."""
    out = df if verbose else df.select(*PUBLISHED)
    by = {"binary_uniform": "difficulty", "decimal_uniform": "difficulty_sd"}.get(digits)
    return out.orderBy(by) if split == "test" and by else out


def bounds_filter(df: DataFrame, values: str, low: float, high: float, distinct: bool = False) -> DataFrame:
    """Lists whose numbers are 0 or inside the bounds, whose mean is not 0 when their length is even, and that are free of repeats on request."""
    v = F.col(values)
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)
    ok = F.forall(v, lambda x: ((F.abs(x) >= low) & (F.abs(x) < high)) | (x == 0)) & ((F.size(v) % 2 == 1) | (mean != 0))
    return df.filter(ok & (F.size(F.array_distinct(v)) == F.size(v)) if distinct else ok)
