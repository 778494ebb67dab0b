"""Quality rules as one Spark projection: a table of thresholds over length, symbol, stop-word and line ratios.

Everything is a built-in column function, so nothing leaves the JVM and nothing is shuffled. Words are runs of characters other
than \\x20 and \\x09-\\x0D.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[ \t\n\x0B\f\r]+"
SYMBOLS = "#*$%&|<>"
#: Words in a repeated window.
WINDOW = 5

# Frequent function words.
STOP_WORDS = (
    "the of and to in a is that it for was on be with as by "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine "
    "de la le et les des en un du une que est pour qui dans par plus pas au sur avec "
    "el y los del se las por con una su para es al lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """`value` (an SQL expression over the measures) must lie from `low` to `high`; a null value passes."""

    name: str
    value: str
    low: float | None = None
    high: float | None = None


#: Measures a value may use: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop_words.
BASE = (
    Rule("few words", "n_words", low=10),
    Rule("repeated words", "100 * n_repeat_words - 20 * n_words", high=0),
)
RULES = (
    Rule("word length", "word_chars / nullif(n_words, 0)", low=1.5, high=15),
    Rule("symbols", "n_symbols / nullif(n_words, 0)", high=0.1),
    Rule("repeated lines", "n_dup_lines / nullif(n_lines, 0)", high=0.3),
    Rule("stop words", "if(n_words >= 100, n_stop_words / n_words, null)", low=0.005),
)


def compiled(rules: tuple[Rule, ...]) -> Column:
    """The names of the rules a row breaks, as one expression."""
    names = []
    for r in rules:
        value = F.expr(f"double({r.value})")
        broken = F.lit(False)
        if r.low is not None:
            broken = broken | (value < F.lit(float(r.low)))
        if r.high is not None:
            broken = broken | (value > F.lit(float(r.high)))
        names.append(F.when(F.coalesce(broken, F.lit(False)), F.lit(r.name)))
    return F.array_compact(F.array(*names))


def _repeat_words(placed: Column) -> Column:
    """Words in windows found twice or more. `placed`: (hash, place) of the windows in order of hash, null if none recurs."""
    same = F.filter(placed, lambda x, k: (x["h"] == F.get(placed, k - 1)["h"]) | (x["h"] == F.get(placed, k + 1)["h"]))
    places = F.array_sort(F.transform(same, lambda x: x["i"]))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-WINDOW).alias("end"))
    covered = F.aggregate(
        places, start,
        lambda got, i: F.struct((got["n"] + F.least(F.lit(WINDOW), i - got["end"])).alias("n"), i.alias("end")))
    return F.coalesce(F.when(placed.isNotNull(), covered["n"]), F.lit(0).cast("bigint"))


def measured(docs: DataFrame, text: str = "text", name: str = "measures") -> DataFrame:
    """Adds `name`: a struct of the measures of the text (null: no words). Other columns stay; `name` replaces one of that name.

    Windows of words are told apart by their 64-bit hashes within one text.
    """
    kept = [c for c in docs.columns if c != name]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.select("_row", F.array_remove(F.split("_text", SPACE), "").alias("_words"),
                       F.filter(F.split("_text", "\n"), lambda line: F.translate(line, " \t\u000b\f\r", "") != "").alias("_lines"))
    words = F.col("_words")
    place = F.when(F.size(words) >= WINDOW, F.sequence(F.lit(0), F.size(words) - WINDOW)).otherwise(F.array().cast("array<int>"))
    rows = rows.select("*", F.transform(place, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])).alias("_windows"), F.array_join(words, "").alias("_joined"))
    recurs = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.when(recurs, F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    rows = rows.select("*", placed.alias("_placed"))
    long = lambda c: c.cast("bigint")
    measures = F.struct(
        long(F.size(words)).alias("n_words"), long(F.length("_joined")).alias("word_chars"),
        long(F.length("_joined") - F.length(F.translate("_joined", SYMBOLS, ""))).alias("n_symbols"),
        long(F.size("_lines")).alias("n_lines"), long(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        _repeat_words(F.col("_placed")).alias("n_repeat_words"),
        long(F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS)))).alias("n_stop_words"))
    return rows.select(*[F.col("_row")[c].alias(c) for c in kept], measures.alias(name))


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, the measures, base_failed, broken (names of the rules broken) and kept, for every row."""
    rows = measured(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text").select("doc_id", "measures.*")
    rows = rows.select("*", (F.size(compiled(base)) > 0).alias("base_failed"), compiled(rules).alias("broken"))
    return rows.select("*", (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept"))


def _sql_broken(rules: tuple[Rule, ...]) -> str:
    parts = []
    for r in rules:
        value = r.value.replace(" / ", "::double / ")
        parts += [f"coalesce({value} < {r.low}, false)"] * (r.low is not None) + [f"coalesce({value} > {r.high}, false)"] * (r.high is not None)
    return " or ".join(parts)


ORACLE = f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
w as (select rid, doc_id, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from d),
g as (select rid, i, ws[i:i+4] as five from (select rid, ws, unnest(generate_series(1, len(ws) - 4)) as i from w)),
r as (select rid, i from g qualify count(*) over (partition by rid, five) > 1),
c as (select rid, count(distinct i + k) as n from r, (select unnest([0, 1, 2, 3, 4]) as k) group by rid),
m as (select doc_id, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars,
    length(array_to_string(ws, '')) - length(regexp_replace(array_to_string(ws, ''), '[#*$%&|<>]', '', 'g')) as n_symbols,
    len(ls) as n_lines, len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words,
    len(list_filter(ws, lambda x: list_contains([{", ".join(repr(w) for w in STOP_WORDS)}], lower(x)))) as n_stop_words
    from w left join c on c.rid = w.rid),
b as (select *, ({_sql_broken(BASE)}) as base_failed, ({_sql_broken(RULES)}) as broken from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (not base_failed and not broken) as kept from b
"""
