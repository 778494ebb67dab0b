"""Problem and result tables derived from the given tables.

Each view is a table plus layers of column expressions that Spark and the checking engine both read,
so that a query and its SQL twin start from the same rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.plans.registry import spread, table


def _text(decimal: str) -> str:
    """Text of a two-decimal amount without trailing zeros."""
    return f"regexp_replace(CAST({decimal} AS STRING), '[.]?0+$', '')"


def _case(value: str, options: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{o}'" for i, o in enumerate(options))
    return f"CASE {value} {arms} END"


_TASKS = ["Addition", "Division", "Exponentiation", "Interval", "Mean", "MinMax", "Multiplication", "Sorting", "Std"]
_MODELS = [
    "deepseek__deepseek-chat-v3.1", "google__gemini-2.5-flash", "google__gemini-2.5-pro", "meta-llama__llama-4-maverick",
    "moonshotai__kimi-k2-0905", "openai__gpt-4.1", "openai__gpt-5", "openai__gpt-oss-120b", "qwen__qwen3-235b-a22b-2507",
    "qwen__qwen3-235b-a22b-thinking-2507", "x-ai__grok-4-fast_free",
]
_LETTER = "substr('ABCDEF', CAST(1 + l_suppkey % 6 AS INT), 1)"
_OTHER = "substr('ABCDEF', CAST(1 + (l_suppkey + 1) % 6 AS INT), 1)"

VIEWS: dict[str, tuple[str, list[dict[str, str]], list[str]]] = {
    # two operands with their sum, difference and product, as exact decimal text
    "v_problems": (
        "lineitem",
        [
            {
                "q": "CAST(l_quantity AS DECIMAL(12,2))", "p": "CAST(l_extendedprice AS DECIMAL(12,2))",
                "operator": "CASE WHEN l_partkey % 2 = 0 THEN '+' ELSE '-' END",
            },
            {
                "num1": _text("p"), "num2": _text("q"),
                "total": _text("CASE WHEN operator = '+' THEN p + q ELSE p - q END"),
                "prod": "regexp_replace(CAST(p * q AS STRING), '[.]?0+$', '')",
                "num1_exp": "CAST(floor(log10(l_extendedprice)) AS INT)", "num2_exp": "CAST(floor(log10(l_quantity)) AS INT)",
            },
        ],
        ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_shipdate", "operator",
         "num1", "num2", "total", "prod", "num1_exp", "num2_exp"],
    ),
    # a list of three numbers per order line
    "v_lists": (
        "lineitem",
        [
            {
                "a": _text("CAST(l_extendedprice AS DECIMAL(12,2))"),
                "b": _text("CAST(l_extendedprice AS DECIMAL(12,2)) - CAST(l_quantity AS DECIMAL(12,2))"),
                "c": _text("CAST(l_quantity * 100 AS DECIMAL(12,2))"),
                "ref": _text("CAST(l_suppkey * 37.5 AS DECIMAL(12,2))"),
            },
        ],
        ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity", "a", "b", "c", "ref"],
    ),
    # a predicted and a true number
    "v_preds": (
        "lineitem",
        [
            {
                "truth": "l_extendedprice",
                "pred": "CASE l_orderkey % 5 WHEN 0 THEN l_extendedprice WHEN 1 THEN l_extendedprice + 0.01 "
                "WHEN 2 THEN l_extendedprice * 1.01 WHEN 3 THEN -l_extendedprice ELSE l_quantity END",
            },
        ],
        ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "truth", "pred"],
    ),
    # model answers with dimensions, tokens and free text
    "v_results": (
        "lineitem",
        [
            {
                "p": "CAST(l_extendedprice AS DECIMAL(12,2))", "price": "CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING)",
                "task": _case("l_partkey % 9", _TASKS), "model": _case("l_suppkey % 11", _MODELS),
                "reasoning": _case("l_orderkey % 3", ["none", "low", "high"]),
                "difficulty_sd": "CAST(l_quantity AS INT)",
                "tokens": "CASE WHEN l_linenumber = 7 AND l_quantity > 45 THEN 65535 WHEN l_quantity < 3 THEN NULL "
                "ELSE CAST(l_quantity * 40 AS INT) END",
                "kind": "l_orderkey % 5",
            },
            {
                "answer": f"CASE task WHEN 'Interval' THEN {_LETTER} WHEN 'Sorting' THEN concat(CAST(l_linenumber AS STRING), ', ', "
                "CAST(CAST(l_quantity AS INT) AS STRING), ', ', price) ELSE price END",
                "guess": f"CASE task WHEN 'Interval' THEN CASE WHEN kind = 0 THEN {_LETTER} WHEN kind = 1 THEN lower({_LETTER}) ELSE {_OTHER} END "
                "WHEN 'Sorting' THEN CASE WHEN kind < 2 THEN concat(CAST(l_linenumber AS STRING), ', ', CAST(CAST(l_quantity AS INT) AS STRING), "
                "', ', price) ELSE concat(price, ', ', CAST(l_linenumber AS STRING)) END "
                "ELSE CASE kind WHEN 0 THEN price WHEN 1 THEN CAST(p + CAST(0.01 AS DECIMAL(3,2)) AS STRING) "
                "WHEN 2 THEN CAST(CAST(p * CAST(1.01 AS DECIMAL(3,2)) AS DECIMAL(14,3)) AS STRING) ELSE concat('-', price) END END",
            },
            {
                "json_guess": "CASE task WHEN 'Interval' THEN concat('\"', guess, '\"') WHEN 'Sorting' THEN concat('[', guess, ']') ELSE guess END",
            },
            {
                "raw_response": "CASE WHEN kind = 4 THEN CASE l_linenumber % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'I cannot solve this' END "
                "ELSE CASE l_linenumber % 4 WHEN 0 THEN concat('{\"answer\": ', json_guess, '}') "
                "WHEN 1 THEN concat('```json', chr(10), '{\"answer\": ', json_guess, '}', chr(10), '```') "
                "WHEN 2 THEN concat('The result is ', guess, '.') ELSE concat('Sure! {\"answer\": ', json_guess, '} Done.') END END",
                "thoughts": "CASE l_suppkey % 7 WHEN 0 THEN 'I could use Python here' WHEN 1 THEN 'toolbox' WHEN 2 THEN 'ask Wolfram  Alpha' "
                "ELSE 'plain long division' END",
            },
        ],
        ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity", "task", "model", "reasoning",
         "difficulty_sd", "tokens", "answer", "raw_response", "thoughts"],
    ),
    # one result row per order, with a unique row number
    "v_rows": (
        "orders",
        [
            {
                "row_idx": "o_orderkey", "task": _case("o_custkey % 9", _TASKS), "model": _case("o_custkey % 11", _MODELS),
                "reasoning": _case("o_orderkey % 3", ["none", "low", "high"]),
                "text_prompt": "concat('What is ', CAST(o_custkey AS STRING), ' * ', CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING), '?')",
                "answer": "CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING)",
                "prompt_tokens": "CAST(40 + o_custkey % 25 AS INT)",
                "completion_tokens": "CASE WHEN o_orderkey % 50 = 0 THEN 65535 ELSE CAST(o_orderkey % 400 AS INT) END",
                "cost": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_totalprice / 1000000 AS DECIMAL(10,4)) END",
                "performance": "CAST(o_orderkey % 101 AS DOUBLE) / 100",
                "response": "CASE WHEN o_orderkey % 4 = 1 THEN NULL WHEN o_orderkey % 7 = 2 THEN '  ' ELSE concat('{\"answer\": ', "
                "CAST(o_custkey AS STRING), '}') END",
            },
        ],
        ["row_idx", "o_custkey", "o_orderkey", "o_totalprice", "task", "model", "reasoning", "text_prompt", "answer", "prompt_tokens",
         "completion_tokens", "cost", "performance", "response"],
    ),
    # accuracy by task and difficulty over time
    "v_history": (
        "events",
        [
            {
                "task": "event_type", "difficulty": "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 20",
                "acc": "CASE WHEN value > 100 THEN 1.0 ELSE CAST(CAST(value AS DECIMAL(10,2)) AS DOUBLE) / 100 END",
            },
        ],
        ["event_id", "user_id", "ts", "value", "task", "difficulty", "acc"],
    ),
}

# views whose rows get costly text work
HEAVY = {"v_results", "v_problems", "v_lists"}

ROW_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity"]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, layers, columns = VIEWS[name]
    df = table(spark, sf_dir, source)
    if name in HEAVY:
        df = spread(df)
    for layer in layers:
        df = df.selectExpr("*", *[f"{e} AS {n}" for n, e in layer.items()])
    return df.select(*columns)


def view_sql(name: str) -> str:
    source, layers, columns = VIEWS[name]
    inner = source
    for i, layer in enumerate(layers):
        inner = f"(SELECT *, {', '.join(f'{e} AS {n}' for n, e in layer.items())} FROM {inner}) AS l{i}"
    return f"SELECT {', '.join(columns)} FROM {inner}"


def with_views(*names: str) -> str:
    """WITH clause that defines the views in plain SQL."""
    return "WITH " + ", ".join(f"{n} AS ({view_sql(n)})" for n in names)
