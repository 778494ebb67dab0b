"""Model answers: cleaning, parsing to an answer text, truth, score, token counts."""
from __future__ import annotations

import json
import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tallyforge.constants import ANSWER_NUMBER, REGRESSION_TASKS, TOKEN_LIMIT, TOKEN_LIMIT_TEXT
from tallyforge.functions.metrics import log_smape
from tallyforge.functions.text import _col, let, place_point, shortest_digits

JSON_NUMBER = r"-?(?:0|[1-9][0-9]*)(?:[.][0-9]+)?(?:[eE][+-]?[0-9]+)?"
#: What a JSON text may begin with, leniently.
JSON_START = "^[ \\t\\r\\n\ufeff]*[{\\[\"'+.0-9tfnNI/#-]"
RAW_TASKS = ["MinMax", "Sorting"]


# ---- cleaning ----

def strip(text: Column) -> Column:
    """Text without blanks at both ends."""
    return F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))


def single_line(text: Column | str) -> Column:
    """A response on one line: line breaks become spaces, ends are trimmed; null becomes empty."""
    flat = F.regexp_replace(F.coalesce(_col(text), F.lit("")), r"\r\n|\r|\n", " ")
    return strip(flat)


def clean_response(text: Column | str) -> Column:
    """A response without a leading format label, thought blocks and code fences."""
    t = F.regexp_replace(strip(_col(text)), r"^\s*(?:JSON|Json|json)\s*[:\-]?\s*", "")
    t = F.regexp_replace(t, r"(?is)<thought>.*?</thought>", " ")
    t = strip(F.regexp_replace(t, r"(?is)<reasoning>.*?</reasoning>", " "))
    t = F.regexp_replace(t, r"(?i)```(?:json|python|txt)?\s*", "")
    return strip(t)


def mark_token_limit(response: Column | str, tokens: Column | str) -> Column:
    """The response, or a fixed text when the token count says the output limit was hit."""
    return F.when(_col(tokens).try_cast("double") == TOKEN_LIMIT, F.lit(TOKEN_LIMIT_TEXT)).otherwise(_col(response))


# ---- numbers and lists in answers ----

def to_double(text: Column) -> Column:
    """Double of a text that is a number and nothing else."""
    t = F.btrim(text, F.lit(" \t\r\n"))
    return F.when(t.rlike(r"^[+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?$"), t.try_cast("double")).when(
        F.lower(t).rlike(r"^[+-]?(?:inf|infinity|nan)$"), F.lower(t).try_cast("double")
    )


def float_text(x: Column) -> Column:
    """Text of a double: shortest digits, always with a point or an exponent."""
    def write(parts: Column) -> Column:
        digits, exponent = parts["digits"], parts["point"] - 1
        plain = place_point(digits, parts["point"])
        plain = F.when(F.contains(plain, F.lit(".")), plain).otherwise(F.concat(plain, F.lit(".0")))
        mantissa = F.when(F.length(digits) > 1, F.concat(F.substr(digits, F.lit(1), F.lit(1)), F.lit("."), F.substr(digits, F.lit(2)))).otherwise(digits)
        size = F.abs(exponent).cast("string")
        size = F.when(F.length(size) < 2, F.concat(F.lit("0"), size)).otherwise(size)
        power = F.concat(mantissa, F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), size)
        fixed = (F.length(digits) == 0) | ((exponent >= -4) & (exponent < 16))
        return F.when(fixed, plain).otherwise(power)

    def any_value(v: Column) -> Column:
        special = F.when(F.isnan(v), "nan").when(v > 0, "inf").otherwise("-inf")
        finite = ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
        sign = F.when(F.startswith(v.cast("string"), F.lit("-")), "-").otherwise("")
        return F.when(v.isNotNull(), F.when(finite, F.concat(sign, let(shortest_digits(F.abs(v)), write))).otherwise(special))

    return let(x, any_value)


def token_float_text(token: Column) -> Column:
    """Text a double made from a number token would have; short plain decimals need no arithmetic."""
    t = F.ltrim(token, F.lit("+"))
    short = (F.length(t) <= 16) & ~F.contains(t, F.lit("e")) & ~F.contains(t, F.lit("E")) & ~t.rlike("^-?0?[.]0000")
    cut = F.rtrim(t, F.lit("0"))
    cut = F.when(F.endswith(cut, F.lit(".")), F.concat(cut, F.lit("0"))).otherwise(cut)
    cut = F.when(F.startswith(cut, F.lit(".")), F.concat(F.lit("0"), cut)).when(
        F.startswith(cut, F.lit("-.")), F.concat(F.lit("-0"), F.substr(cut, F.lit(2)))).otherwise(cut)
    plain = F.when(F.contains(t, F.lit(".")), cut).otherwise(F.concat(t, F.lit(".0")))
    return F.when(short, plain).otherwise(float_text(token.cast("double")))


def first_number(text: Column) -> Column:
    """First number token of a text, or null."""
    found = F.regexp_extract(text, f"({ANSWER_NUMBER})", 1)
    return F.when(found != "", found)


def all_numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(ANSWER_NUMBER), F.lit(0)), lambda s: s.cast("double"))


def first_numeric_token(text: Column) -> Column:
    """First number token at the start of a text or after a blank, or null."""
    found = F.regexp_extract(text, rf"(?:^|\s)({ANSWER_NUMBER})", 1)
    return F.when(found != "", found)


def interval_label(text: Column) -> Column:
    """First letter A to F that stands alone, in upper case; null when there is none."""
    found = F.regexp_extract(text, r"(?i)(?:^|[^A-Z])([A-F])(?:$|[^A-Z])", 1)
    return F.when(found != "", F.upper(found))


def parse_list(text: Column) -> Column:
    """Numbers of a list-like text: its first bracketed list when that is a list of numbers, else every number."""
    item = rf'(?:{JSON_NUMBER}|"\s*[+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?\s*")'
    pure = rf"^\[\s*(?:{item}(?:\s*,\s*{item})*)?\s*\]$"

    def read(found: Column) -> Column:
        listed = found["list"].rlike(pure)
        numbers = all_numbers(F.when(listed, found["list"]).otherwise(found["text"]))
        return let(numbers, lambda v: F.when(listed | (F.size(v) > 0), v))

    return let(F.struct(F.regexp_extract(text, r"(?s)\[.*?\]", 0).alias("list"), text.alias("text")), read)


# ---- parsing ----

def cut_to_braces(response: Column) -> Column:
    """When there is exactly one pair of braces, only what is inside (with the braces)."""
    opened = F.length(response) - F.length(F.translate(response, "{", ""))
    closed = F.length(response) - F.length(F.translate(response, "}", ""))
    inside = F.substring_index(F.substring_index(response, "{", -1), "}", 1)
    return F.when((opened == 1) & (closed == 1), F.concat(F.lit("{"), inside, F.lit("}"))).otherwise(response)


def _loads(text: str, raw: bool):
    return json.loads(text, parse_float=str, parse_int=str) if raw else json.loads(text)


def _field(text: str, raw: bool) -> str | None:
    try:
        found = _loads(text, raw)
    except ValueError:
        return None
    return str(found["answer"]) if isinstance(found, dict) and "answer" in found else None


_BRACE, _ANSWER_KEY = re.compile(r"[{}]"), re.compile(r"""["']answer["']""")


def balanced_spans(text: str) -> list[tuple[int, int]]:
    """Where each pair of braces that belong together begins and ends, in the order of the beginnings; one scan."""
    waiting, spans = [], []
    for m in _BRACE.finditer(text):
        if m.group() == "{":
            waiting.append(m.start())
        elif waiting:
            spans.append((waiting.pop(), m.end()))
    return sorted(spans)


def answer_span(text: str) -> str | None:
    """The first balanced {...} that holds the answer key in quotes."""
    keys = [m.start() for m in _ANSWER_KEY.finditer(text) if text[m.start()] == text[m.end() - 1]]
    for start, end in balanced_spans(text) if keys else ():
        at = bisect_left(keys, start)
        if at < len(keys) and keys[at] + len('"answer"') <= end:
            return text[start:end]
    return None


@F.pandas_udf(StructType([StructField(n, StringType()) for n in ("whole", "clean", "inner")]))
def _json_answers(text: pd.Series, cleaned: pd.Series, raw: pd.Series) -> pd.DataFrame:
    """JSON answers of the texts that plain patterns do not cover."""
    rows = []
    for t, c, r in zip(text, cleaned, raw):
        if t is None:
            rows.append((None, None, None))
            continue
        inner = answer_span(c)
        rows.append((_field(t, r), _field(c, r), None if inner is None else _field(inner, r)))
    return pd.DataFrame(rows, columns=["whole", "clean", "inner"])


def _plain_value(text: Column) -> Column:
    """What stands behind the answer key when a text is one object with that key first."""
    found = F.regexp_extract(text, r'(?s)^\s*\{\s*"answer"\s*:\s*(\S.*?)\s*\}\s*$', 1)
    return F.when(found != "", found)


def _plain_answer(value: Column, raw: Column) -> Column:
    """Answer text of a value that is a number, a plain string or a list of numbers."""
    number = lambda t: F.when(t == "-0", "0").when(t.rlike("^-?[0-9]+$"), t).otherwise(token_float_text(t))
    items = F.regexp_extract_all(value, F.lit(JSON_NUMBER), F.lit(0))
    quoted = F.concat(F.lit("['"), F.array_join(items, "', '"), F.lit("']"))
    listed = F.concat(F.lit("["), F.array_join(F.transform(items, number), ", "), F.lit("]"))
    inside = F.substr(value, F.lit(2), F.length(value) - 2)
    return (
        F.when(value.rlike(f"^{JSON_NUMBER}$"), F.when(raw, value).otherwise(number(value)))
        .when(value.rlike(r'^"[^"\\\x00-\x1f]+"$'), inside)
        .when(value.rlike(rf"^\[\s*{JSON_NUMBER}(?:\s*,\s*{JSON_NUMBER})*\s*\]$"), F.when(raw, quoted).otherwise(listed))
    )


def parse_answer(df: DataFrame, response: str = "raw_response", task: str = "task") -> DataFrame:
    """Adds `ok`, `parsed_answer` and `reason`.

    Order: JSON answer, else first number of the text; the same on the cleaned text; the first
    balanced object with an answer; the letter or list the task asks for. Later steps only run on
    rows the earlier ones left open, and only texts with braces that are no plain
    {"answer": ...} object go through Python.
    """
    c = F.col
    full = lambda v: F.when(v != "", v)
    t = df.withColumn("_text", cut_to_braces(c(response))).withColumn("_raw", c(task).isin(RAW_TASKS))
    t = t.withColumn("_value", F.when(F.contains(c("_text"), F.lit("{")), _plain_value(c("_text"))))
    t = t.withColumn("_plain", F.when(c("_value").isNotNull(), _plain_answer(c("_value"), c("_raw"))))
    odd = F.contains(c("_text"), F.lit("{")) | ((c(task) == "Sorting") & c("_text").rlike("NaN|Infinity"))
    t = t.withColumn("_odd", F.coalesce(c("_plain").isNull() & odd, F.lit(False)))
    t = t.withColumn("_token", F.when(c("_plain").isNull(), first_number(c("_text"))))
    t = t.withColumn("_open", c("_odd") | (c("_plain").isNull() & c("_token").isNull()))
    t = t.withColumn("_clean", F.when(c("_open"), clean_response(c("_text"))))
    t = t.withColumn("_json", _json_answers(F.when(c("_odd"), c("_text")), c("_clean"), c("_raw")))
    first = full(F.coalesce(c("_plain"), c("_json.whole"), token_float_text(c("_token"))))
    t = t.withColumn("_first", first).withColumn("_clean", F.when(c("_first").isNull(), c("_clean")))
    t = t.withColumn("_list", F.when(c(task) == "Sorting", parse_list(c("_clean"))))
    second = full(F.coalesce(c("_json.clean"), token_float_text(first_number(c("_clean")))))
    list_text = F.concat(F.lit("["), F.array_join(F.transform("_list", float_text), ","), F.lit("]"))
    by_task = F.when(c(task) == "Interval", interval_label(c("_clean"))).when(F.size("_list") > 0, list_text)
    t = t.withColumn("_second", F.when(c("_first").isNull(), second)).withColumn("_by_task", F.when(c("_first").isNull(), by_task))
    t = t.withColumn("_found", F.coalesce(c("_first"), c("_second"), c("_json.inner"), c("_by_task")))
    reason = F.when(c(response).isNull(), "non_string_response").when(c("_found").isNull(), "unparseable").otherwise("")
    return (
        t.withColumn("ok", c("_found").isNotNull()).withColumn("parsed_answer", F.coalesce(c("_found"), F.lit(""))).withColumn("reason", reason)
        .drop("_text", "_raw", "_value", "_plain", "_odd", "_token", "_open", "_clean", "_json", "_first", "_list", "_second", "_by_task", "_found")
    )


def is_strict_json(text: Column | str) -> Column:
    """Whether a text is one JSON object and nothing around it."""
    t = strip(_col(text))
    shaped = F.startswith(t, F.lit("{")) & F.endswith(t, F.lit("}"))
    # read as the only entry of a list: text after the object breaks the list or adds an entry
    parsed = F.try_parse_json(F.when(shaped, F.concat(F.lit("["), t, F.lit("]"))))
    return F.coalesce(shaped & parsed.isNotNull() & F.try_variant_get(parsed, "$[1]", "string").isNull(), F.lit(False))


# ---- truth and score ----

def _unquote(text: Column) -> Column:
    return F.btrim(F.btrim(strip(text), F.lit('"')), F.lit("'"))


def normalize_truth(df: DataFrame, answer: str = "answer", task: str = "task") -> DataFrame:
    """Adds `truth_text`, `truth_number` and `truth_list`; each is set for the tasks that compare it."""
    text = F.coalesce(F.col(answer), F.lit(""))
    by_task = (
        F.when(F.col(task) == "Interval", F.coalesce(interval_label(text), F.lit("")))
        .when(F.col(task) == "MinMax", _unquote(text))
    )
    return (
        df.withColumn("truth_text", by_task)
        .withColumn("truth_number", F.when(F.col(task).isin(REGRESSION_TASKS), to_double(text)))
        .withColumn("truth_list", F.when(F.col(task) == "Sorting", F.coalesce(parse_list(strip(text)), F.array().cast("array<double>"))))
    )


def _signature(token: Column) -> Column:
    """Sign, first 15 digits and decimal exponent of a number token, as one text."""
    t = F.upper(F.ltrim(token, F.lit("+-")))
    mantissa = F.substring_index(t, "E", 1)
    power = F.when(F.contains(t, F.lit("E")), F.substring_index(t, "E", -1).cast("int")).otherwise(0)
    raw = F.translate(mantissa, ".", "")
    body = F.ltrim(raw, F.lit("0"))
    power = F.length(F.substring_index(mantissa, ".", 1)) - (F.length(raw) - F.length(body)) - 1 + power
    power = F.when(F.length(body) > 0, power).otherwise(0)
    sign = F.when(F.startswith(token, F.lit("-")), "-").otherwise("+")
    return F.concat(sign, F.rpad(F.substr(body, F.lit(1), F.lit(15)), 15, "0"), F.lit("E"), power.cast("string"))


def exact15(pred: Column | str, truth: Column | str) -> Column:
    """1 when the first numbers of both texts agree in sign, first 15 digits and exponent."""
    a, b = first_numeric_token(_col(pred)), first_numeric_token(_col(truth))
    return F.coalesce((let(a, _signature) == let(b, _signature)).cast("int"), F.lit(0))


def score_answers(df: DataFrame, parsed: str = "parsed_answer", answer: str = "answer", task: str = "task") -> DataFrame:
    """Adds `performance` in [0, 1] and `exact15` (regression tasks only)."""
    c = F.col
    t = normalize_truth(df, answer, task)
    regression = c(task).isin(REGRESSION_TASKS)
    t = t.withColumn("_number", F.when(regression, to_double(c(parsed))))
    t = t.withColumn("_list", F.when(c(task) == "Sorting", parse_list(strip(c(parsed)))))
    t = t.withColumn("_a", F.when(regression, first_numeric_token(c(parsed)))).withColumn("_b", F.when(regression, first_numeric_token(c(answer))))
    listed = F.coalesce(c("_list"), F.array().cast("array<double>"))
    score = (
        F.when(regression, F.coalesce(log_smape(c("_number"), c("truth_number")), F.lit(0.0)))
        .when(c(task) == "Interval", (F.upper(strip(c(parsed))) == c("truth_text")).cast("double"))
        .when(c(task) == "Sorting", (listed == c("truth_list")).cast("double"))
        .when(c(task) == "MinMax", (_unquote(c(parsed)) == c("truth_text")).cast("double"))
        .otherwise(0.0)
    )
    return (
        t.withColumn("performance", F.coalesce(score, F.lit(0.0)))
        .withColumn("exact15", F.when(regression, F.coalesce((_signature(c("_a")) == _signature(c("_b"))).cast("int"), F.lit(0))).otherwise(0))
        .drop("truth_text", "truth_number", "truth_list", "_number", "_list", "_a", "_b")
    )


# ---- usage and tool mentions ----

def usage_tokens(usage: Column | str) -> Column:
    """Best token count of a usage JSON: reasoning, completion, total, output, nested reasoning, else -1."""
    usage = _col(usage)
    whole = lambda path: F.get_json_object(usage, path).try_cast("double").cast("bigint")
    keys = ["reasoning_tokens", "completion_tokens", "total_tokens", "output_tokens", "completion_tokens_details.reasoning_tokens"]
    return F.coalesce(*[whole(f"$.{k}") for k in keys], F.lit(-1).cast("bigint"))


def usage_flat(usage: Column | str, depth: int = 3) -> Column:
    """Map of a nested usage JSON with dotted keys."""
    empty = F.create_map().cast("map<string,string>")
    level = F.coalesce(F.from_json(_col(usage), "map<string,string>"), empty)
    for _ in range(depth):
        def expand(entry: Column) -> Column:
            nested = F.from_json(entry["value"], "map<string,string>")
            inner = F.transform(
                F.map_entries(nested),
                lambda e: F.struct(F.concat(entry["key"], F.lit("."), e["key"]).alias("key"), e["value"].alias("value")),
            )
            return F.when(F.startswith(entry["value"], F.lit("{")) & nested.isNotNull(), inner).otherwise(F.array(entry))
        level = F.map_from_entries(F.flatten(F.transform(F.map_entries(level), expand)))
    return level


def mentions_tool(text: Column | str) -> Column:
    return F.coalesce(_col(text).rlike(r"(?i)\b(calculator|python|wolfram\s*alpha|tool)\b"), F.lit(False))


def tool_mentions(df: DataFrame, reasoning: str = "reasoning", task: str = "task") -> DataFrame:
    """Rows whose reasoning mentions a tool; the score shows as logSMAPE or as correct, by task."""
    numeric = F.col(task).isin(REGRESSION_TASKS)
    return (
        df.filter(mentions_tool(reasoning))
        .withColumn("logSMAPE", F.when(numeric, F.col("performance")))
        .withColumn("correct", F.when(~numeric, F.col("performance") >= 0.999999))
    )


# ---- schema ----

def _number_kind(kind: Column) -> Column:
    return kind.rlike(r"^(?:BIGINT|DOUBLE|FLOAT|DECIMAL\(.*\))$")


def schema_violation(text: Column | str, schema: dict) -> Column:
    """How a text breaks a JSON schema of an object, or null: not_json, not_object, missing_field, extra_field, wrong_type, wrong_item
    or not_in_enum, in this order. Fields may be numbers, strings (of an enum, too) or arrays of numbers.
    """
    def broken(parts: Column) -> Column:
        out = F.when(parts["json"].isNull(), "not_json").when(~F.startswith(parts["kind"], F.lit("OBJECT<")), "not_object")
        for name in schema.get("required", ()):
            out = out.when(~F.array_contains(parts["fields"], name), "missing_field")
        if schema.get("additionalProperties") is False:
            allowed = F.array(*[F.lit(n) for n in schema["properties"]])
            out = out.when(F.size(F.array_except(parts["fields"], allowed)) > 0, "extra_field")
        for name, wanted in schema["properties"].items():
            value = F.try_variant_get(parts["json"], f"$.{name}", "variant")
            kind, present = F.schema_of_variant(value), F.array_contains(parts["fields"], name)
            if wanted["type"] == "array":
                odd = F.exists(F.try_variant_get(value, "$", "array<variant>"), lambda v: ~_number_kind(F.schema_of_variant(v)))
                out = out.when(present & ~F.startswith(kind, F.lit("ARRAY<")), "wrong_type").when(present & odd, "wrong_item")
            elif wanted["type"] == "number":
                out = out.when(present & ~_number_kind(kind), "wrong_type")
            else:
                out = out.when(present & (kind != "STRING"), "wrong_type")
            if "enum" in wanted:
                out = out.when(present & ~F.try_variant_get(value, "$", "string").isin(wanted["enum"]), "not_in_enum")
        return out

    def parts(read: Column) -> Column:
        fields = F.when(F.startswith(read["kind"], F.lit("OBJECT<")), F.json_object_keys(_col(text)))
        return F.struct(read["json"].alias("json"), read["kind"].alias("kind"), F.coalesce(fields, F.array().cast("array<string>")).alias("fields"))

    # a text is parsed once; one that no JSON begins like is not parsed, as a failure costs more than all else
    parsed = F.try_parse_json(F.when(_col(text).rlike(JSON_START), _col(text)))
    read = let(parsed, lambda v: F.struct(v.alias("json"), F.schema_of_variant(v).alias("kind")))
    return let(let(read, parts), broken)
