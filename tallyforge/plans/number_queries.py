"""Queries on numbers: text shape, extraction, difficulty, metrics, encodings."""
from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.constants import NUMBER, magnitude_edges
from tallyforge.functions import difficulty as D
from tallyforge.functions import encode as E
from tallyforge.functions import metrics as M
from tallyforge.functions import text as T
from tallyforge.plans.registry import query, spread, table
from tallyforge.plans.views import view, with_views

KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity"]
KEY_SQL = ", ".join(KEY)


# ---- number text ----

def sql_sig(text: str) -> str:
    return f"CAST(length(trim(replace(replace({text}, '-', ''), '.', ''), '0')) AS INT)"


@query("sig_digits", with_views("v_problems") + f"""
SELECT {KEY_SQL}, num1, total, {sql_sig('num1')} AS num1_digits, {sql_sig('total')} AS total_digits FROM v_problems""")
def sig_digits(spark, sf):
    t = view(spark, sf, "v_problems")
    return t.select(*KEY, "num1", "total", T.sig_digits("num1").alias("num1_digits"), T.sig_digits("total").alias("total_digits"))


@query("fixed_point", with_views("v_problems") + f"""
SELECT {KEY_SQL}, num1 AS plain, CASE WHEN l_linenumber % 2 = 0 THEN CAST(CAST(p * 100 AS BIGINT) AS VARCHAR) || '000000000000'
  ELSE regexp_replace('0.00000' || lpad(replace(num1, '.', ''), 10, '0'), '0+$', '') END AS shifted
FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(12,2)) AS p FROM v_problems)""")
def fixed_point(spark, sf):
    t = view(spark, sf, "v_problems")
    # cents times 10 ** 12 and very small amounts, both beyond what a double prints without an exponent
    big = (F.col("l_extendedprice").cast("decimal(12,2)") * 100).cast("bigint").cast("double") * 1e12
    small = F.concat(F.lit("0.00000"), F.lpad(F.translate("num1", ".", ""), 10, "0")).cast("double")
    shifted = F.when(F.col("l_linenumber") % 2 == 0, big).otherwise(small)
    return t.select(*KEY, T.fixed_point("l_extendedprice").alias("plain"), T.fixed_point(shifted).alias("shifted"))


@query("round_sig", with_views("v_problems") + f""",
  s AS (SELECT {KEY_SQL}, l_extendedprice AS x, 2 + l_partkey % 4 AS d, CAST(floor(log10(l_extendedprice)) AS INT) AS mag FROM v_problems),
  n AS (SELECT *, CAST(round_even(x / pow(10, mag) * pow(10, d - 1), 0) AS BIGINT) AS whole FROM s)
SELECT {KEY_SQL}, CASE WHEN d - 1 <= mag THEN CAST(whole * CAST(pow(10, mag - d + 1) AS BIGINT) AS VARCHAR)
  ELSE regexp_replace(CAST(CAST(whole / pow(10, d - 1 - mag) AS DECIMAL(20,4)) AS VARCHAR), '[.]?0+$', '') END AS rounded FROM n""")
def round_sig(spark, sf):
    t = view(spark, sf, "v_problems")
    return t.select(*KEY, T.round_sig("num1", (F.lit(2) + F.col("l_partkey") % 4).cast("int")).alias("rounded"))


@query("round_bits", with_views("v_problems") + f""",
  s AS (SELECT {KEY_SQL}, l_extendedprice AS x, 3 + l_partkey % 20 AS p, CAST(floor(log2(l_extendedprice)) AS INT) AS e FROM v_problems)
SELECT {KEY_SQL}, round_even(x * pow(2.0, p - 1 - e), 0) / pow(2.0, p - 1 - e) AS rounded FROM s""")
def round_bits(spark, sf):
    t = view(spark, sf, "v_problems")
    return t.select(*KEY, T.round_bits("l_extendedprice", (F.lit(3) + F.col("l_partkey") % 20).cast("int")).alias("rounded"))


@query("base_text", """
SELECT o_orderkey, bin(o_orderkey) AS base2, upper(hex(o_orderkey)) AS base16, CAST(o_orderkey AS DOUBLE) AS back,
  CASE WHEN o_orderkey < 4 THEN '0' ELSE substr(bin(o_orderkey), 1, length(bin(o_orderkey)) - 2) || '00' END AS low_cleared,
  CASE WHEN o_orderkey = 0 THEN -1 ELSE CAST(length(bin(o_orderkey)) - length(rtrim(bin(o_orderkey), '0')) AS INT) END AS lowest
FROM orders""")
def base_text(spark, sf):
    t = table(spark, sf, "orders").select("o_orderkey", T.base_text("o_orderkey", 2).alias("base2"))
    return t.select(
        "o_orderkey", "base2", T.base_text("o_orderkey", 16).alias("base16"), T.base_value("base2", 2).alias("back"),
        T.quantize_low("base2", 2).alias("low_cleared"), T.lowest_set_digit("base2").alias("lowest"),
    )


# ---- numbers in text ----

_TEXTS = """texts AS (SELECT 'documents' AS source, doc_id AS id, text FROM documents UNION ALL SELECT 'pages', page_id, html FROM pages)"""


def texts(spark, sf):
    docs = table(spark, sf, "documents").select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"), "text")
    pages = table(spark, sf, "pages").select(F.lit("pages").alias("source"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    return spread(docs).unionByName(spread(pages))


_FOUND = f"""found AS (SELECT source, id, unnest(regexp_extract_all(text, '{NUMBER}')) AS token,
  unnest(range(len(regexp_extract_all(text, '{NUMBER}')))) AS pos FROM texts)"""


@query("extract_numbers", f"WITH {_TEXTS}, {_FOUND} SELECT source, id, CAST(pos AS INT) AS pos, CAST(token AS DOUBLE) AS number FROM found")
def extract_numbers(spark, sf):
    return texts(spark, sf).select("source", "id", F.posexplode(T.extract_numbers("text")).alias("pos", "number"))


_EDGES = "[" + ", ".join(f"CAST('{e!r}' AS DOUBLE)" for e in magnitude_edges()) + "]"


@query("replace_numbers", f"""WITH {_TEXTS}, one AS (SELECT source, id, regexp_replace(text, '{NUMBER}', '<|num|>', 'g') AS text FROM texts)
SELECT source, id, md5(text) AS text_md5, CAST((length(text) - length(replace(text, '<|num|>', ''))) / 7 AS INT) AS n_numbers FROM one""")
def replace_numbers(spark, sf):
    t = texts(spark, sf).select("source", "id", T.replace_numbers("text").alias("r"))
    return t.select("source", "id", F.md5("r.text").alias("text_md5"), F.size("r.numbers").alias("n_numbers"))


@query("replace_numbers_magnitude", f"""WITH {_TEXTS}, {_FOUND}, edges AS (SELECT {_EDGES} AS e),
  kinds AS (SELECT source, id, pos, len(list_filter(e, lambda x: x <= CAST(token AS DOUBLE))) AS bin FROM found, edges)
SELECT source, id, string_agg('<|num_' || CAST(bin AS VARCHAR) || '|>', '' ORDER BY pos) AS tokens FROM kinds GROUP BY source, id""")
def replace_numbers_magnitude(spark, sf):
    t = texts(spark, sf).select("source", "id", T.replace_numbers("text", magnitude=True).alias("r"))
    tokens = F.array_join(F.regexp_extract_all("r.text", F.lit(r"<\|num_[0-9]+\|>"), F.lit(0)), "")
    return t.select("source", "id", tokens.alias("tokens")).filter(F.col("tokens") != "")


@query("magnitude_bins", f"""WITH edges AS (SELECT {_EDGES} AS e)
SELECT CAST(len(list_filter(e, lambda x: x <= l_extendedprice - 20000)) AS INT) AS bin, count(*) AS n
FROM lineitem, edges GROUP BY 1""")
def magnitude_bins(spark, sf):
    t = spread(table(spark, sf, "lineitem").select("l_extendedprice")).select(T.magnitude_bin(F.col("l_extendedprice") - 20000).alias("bin"))
    return t.groupBy("bin").agg(F.count("*").alias("n"))


@query("split_large_numbers", f"""WITH {_TEXTS}, {_FOUND},
  d0 AS (SELECT source, id, pos AS k, token, CASE WHEN starts_with(token, '-') THEN '-' ELSE '' END AS sign, rtrim(split_part(ltrim(token, '+-') || '.', '.', 2), '0') AS f,
    ltrim(split_part(ltrim(token, '+-') || '.', '.', 1) || rtrim(split_part(ltrim(token, '+-') || '.', '.', 2), '0'), '0') AS d FROM found),
  d01 AS (SELECT *, f = '' AND coalesce(TRY_CAST(token AS HUGEINT) = TRY_CAST(CAST(token AS DOUBLE) AS HUGEINT), false) AS whole FROM d0),
  d1 AS (SELECT *, CASE WHEN whole THEN '' ELSE ltrim(substr(d, 16), '0') END AS d2 FROM d01), d3 AS (SELECT *, ltrim(substr(d2, 16), '0') AS d3 FROM d1),
  parts AS (SELECT source, id, k, 1 AS i, CASE WHEN whole THEN CAST(token AS DOUBLE) WHEN d = '' THEN 0.0 ELSE CAST(sign || substr(d, 1, 15) || 'e' || CAST(greatest(length(d) - 15, 0) - length(f) AS VARCHAR) AS DOUBLE) END AS number FROM d3
    UNION ALL SELECT source, id, k, 2, CAST(sign || substr(d2, 1, 15) || 'e' || CAST(greatest(length(d2) - 15, 0) - length(f) AS VARCHAR) AS DOUBLE) FROM d3 WHERE d2 <> ''
    UNION ALL SELECT source, id, k, 3, CAST(sign || substr(d3, 1, 15) || 'e' || CAST(greatest(length(d3) - 15, 0) - length(f) AS VARCHAR) AS DOUBLE) FROM d3 WHERE d3 <> '')
SELECT source, id, CAST(row_number() OVER (PARTITION BY source, id ORDER BY k, i) - 1 AS INT) AS pos, number FROM parts""")
def split_large_numbers(spark, sf):
    return texts(spark, sf).select("source", "id", F.posexplode(T.split_large_numbers("text")).alias("pos", "number"))


# ---- difficulty ----

def sql_nonzero(text: str) -> str:
    return f"greatest(1, length(regexp_replace({text}, '[^1-9A-Za-z]', '', 'g')))"


@query("difficulty_mul", with_views("v_problems") + f"""
SELECT {KEY_SQL}, CAST({sql_nonzero('num1')} + {sql_nonzero('num2')} AS INT) AS difficulty_sd,
  CAST({sql_nonzero('num1')} + {sql_nonzero('num2')} + {sql_nonzero('prod')} AS INT) AS with_result FROM v_problems""")
def difficulty_mul(spark, sf):
    t = view(spark, sf, "v_problems")
    return t.select(*KEY, D.difficulty_mul("num1", "num2").alias("difficulty_sd"), D.difficulty_mul("num1", "num2", "prod").alias("with_result"))


@query("difficulty_div", with_views("v_problems") + f""",
  s AS (SELECT *, greatest(1, length(replace(replace(replace(prod, '.', ''), '-', ''), '0', ''))) AS digits FROM v_problems)
SELECT {KEY_SQL}, CAST(digits + CASE WHEN l_quantity IN (0.1, 0.01, 0.001, 1, 10, 100, 1000, 10000) THEN 1
    WHEN CAST(l_quantity AS BIGINT) IN (1, 2, 4, 8, 16, 32, 64) THEN 2 ELSE 4 END
  + CASE WHEN (contains(prod, '.') OR contains(num1, '.')) AND digits > 2 THEN 2 WHEN contains(prod, '.') OR contains(num1, '.') THEN 1 ELSE 0 END
  AS DOUBLE) AS difficulty FROM s""")
def difficulty_div(spark, sf):
    t = view(spark, sf, "v_problems")
    return t.select(*KEY, D.difficulty_div("prod", "num2", "num1").alias("difficulty"))


def sql_differs(a: str, b: str) -> str:
    return f"len([i FOR i IN range(1, least(length({a}), length({b})) + 1) IF substr({a}, i, 1) <> substr({b}, i, 1)])"


@query("difficulty_add", with_views("v_problems") + f""",
  s AS (SELECT {KEY_SQL}, replace(num1, '.', '') AS a, replace(num2, '.', '') AS b, replace(total, '.', '') AS c,
    CASE WHEN abs(CAST(num1 AS DOUBLE)) >= abs(CAST(num2 AS DOUBLE)) THEN replace(num1, '.', '') ELSE replace(num2, '.', '') END AS top FROM v_problems)
SELECT {KEY_SQL}, CAST({sql_differs('top', 'c')} + 3 * len([i FOR i IN range(1, least(length(a), length(b)) + 1)
  IF substr(a, i, 1) <> '0' AND substr(b, i, 1) <> '0']) AS INT) AS difficulty_sd FROM s""")
def difficulty_add(spark, sf):
    t = view(spark, sf, "v_problems")
    return t.select(*KEY, D.difficulty_add(["num1", "num2"], "total").alias("difficulty_sd"))


_PARTS = """
  p AS (SELECT *, split_part(a, '.', 1) AS a0, split_part(a, '.', 2) AS a1, split_part(b, '.', 1) AS b0, split_part(b, '.', 2) AS b1,
    split_part(c, '.', 1) AS c0, split_part(c, '.', 2) AS c1 FROM v_lists)"""


def sql_zfill(t: str, n: str) -> str:
    return f"CASE WHEN {t} LIKE '-%' THEN '-' || lpad(substr({t}, 2), CAST({n} - 1 AS INT), '0') ELSE lpad({t}, CAST({n} AS INT), '0') END"


def sql_aligned(names: str, whole: bool) -> str:
    """Aligned texts xa, xb, ... of the named numbers, each split into <n>0 and <n>1."""
    w = "greatest(" + ", ".join(f"length({n}0)" for n in names) + ")"
    f = "greatest(" + ", ".join(f"length({n}1)" for n in names) + ")"
    out = []
    for n in names:
        left = sql_zfill(f"{n}0", w) if whole else f"{n}0"
        out.append(f"{left} || CASE WHEN {f} > 0 THEN '.' || rpad({n}1, CAST({f} AS INT), '0') ELSE '' END AS x{n}")
    return ", ".join(out)


def sql_prefix(a: str, b: str) -> str:
    return (
        f"coalesce(list_min([i FOR i IN range(1, least(length({a}), length({b})) + 1) IF substr({a}, i, 1) <> substr({b}, i, 1)]) - 1, "
        f"least(length({a}), length({b})))"
    )


@query("difficulty_minmax", with_views("v_lists") + f""",{_PARTS},
  d AS (SELECT p.*, CASE WHEN l_linenumber % 2 = 0 THEN a ELSE c END AS m FROM p),
  s AS (SELECT *, {sql_aligned('abc', True)} FROM d),
  t AS (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN xa ELSE xc END AS xm FROM s),
  u AS (SELECT *, CASE WHEN a = m THEN 0 ELSE {sql_prefix('xa', 'xm')} END + CASE WHEN b = m THEN 0 ELSE {sql_prefix('xb', 'xm')} END
    + CASE WHEN c = m THEN 0 ELSE {sql_prefix('xc', 'xm')} END AS score FROM t)
SELECT {KEY_SQL}, CAST(CASE WHEN score > 0 THEN ceil(pow(score, 0.8)) ELSE 0 END AS INT) AS difficulty_sd FROM u""")
def difficulty_minmax(spark, sf):
    t = view(spark, sf, "v_lists")
    m = F.when(F.col("l_linenumber") % 2 == 0, F.col("a")).otherwise(F.col("c"))
    return t.select(*KEY, D.difficulty_minmax(F.array("a", "b", "c"), m).alias("difficulty_sd"))


@query("difficulty_sort", with_views("v_lists") + f""",{_PARTS}, s AS (SELECT *, {sql_aligned('abc', True)} FROM p),
  u AS (SELECT *, {sql_prefix('xa', 'xb')} + {sql_prefix('xa', 'xc')} + {sql_prefix('xb', 'xc')} AS score FROM s)
SELECT {KEY_SQL}, CAST(CASE WHEN score > 0 THEN ceil(pow(score, 0.8)) ELSE 0 END AS INT) AS difficulty_sd FROM u""")
def difficulty_sort(spark, sf):
    return view(spark, sf, "v_lists").select(*KEY, D.difficulty_sort(F.array("a", "b", "c")).alias("difficulty_sd"))


@query("difficulty_pow", with_views("v_problems") + f"""
SELECT {KEY_SQL}, CAST(round_even(pow({sql_nonzero('num1')} * {sql_nonzero('num2')} * {sql_nonzero('prod')}, 0.4), 0) AS INT) AS difficulty_sd FROM v_problems""")
def difficulty_pow(spark, sf):
    return view(spark, sf, "v_problems").select(*KEY, D.difficulty_pow("num1", "num2", "prod").alias("difficulty_sd"))


@query("difficulty_mean", with_views("v_lists") + f""",{_PARTS}, s AS (SELECT *, {sql_aligned('abc', False)} FROM p),
  u AS (SELECT *, least({sql_prefix('xa', 'xb')}, {sql_prefix('xa', 'xc')}) AS n FROM s)
SELECT {KEY_SQL}, CAST({sql_nonzero('substr(xa, n + 1)')} + {sql_nonzero('substr(xb, n + 1)')} + {sql_nonzero('substr(xc, n + 1)')} + 16 AS INT)
  AS difficulty_sd FROM u""")
def difficulty_mean(spark, sf):
    return view(spark, sf, "v_lists").select(*KEY, D.difficulty_mean(F.array("a", "b", "c")).alias("difficulty_sd"))


_HALVES = """
  ls AS (SELECT *, 2 + l_partkey % 8 AS n, [CAST(l_extendedprice AS DECIMAL(14,2)) + CAST(i * l_quantity AS DECIMAL(14,2)) FOR i IN range(1, 3 + l_partkey % 8)] AS v FROM v_lists),
  hs AS (SELECT *, list_sum(v[:n // 2]) AS l, list_sum(v[n // 2 + 1:]) AS r FROM ls),
  ts AS (SELECT *, regexp_replace(CAST(l AS VARCHAR), '[.]?0+$', '') AS x, regexp_replace(CAST(r AS VARCHAR), '[.]?0+$', '') AS y, regexp_replace(CAST(l + r AS VARCHAR), '[.]?0+$', '') AS z FROM hs)"""


@query("difficulty_add_tree", with_views("v_lists") + f""",{_HALVES},
  u AS (SELECT *, replace(x, '.', '') AS a1, replace(y, '.', '') AS a2, replace(z, '.', '') AS a3,
    CASE WHEN abs(CAST(x AS DOUBLE)) >= abs(CAST(y AS DOUBLE)) THEN replace(x, '.', '') ELSE replace(y, '.', '') END AS top FROM ts)
SELECT {KEY_SQL}, CAST(n AS INT) AS n, CAST({sql_differs('top', 'a3')} + 3 * len([i FOR i IN range(1, least(length(a1), length(a2)) + 1)
  IF substr(a1, i, 1) <> '0' AND substr(a2, i, 1) <> '0']) AS INT) AS difficulty FROM u""")
def difficulty_add_tree(spark, sf):
    # lists of 2 to 9 amounts, one quantity further each
    n = F.col("l_partkey") % 8 + 2
    amount = lambda i: F.col("l_extendedprice").cast("decimal(14,2)") + (i * F.col("l_quantity")).cast("decimal(14,2)")
    texts_ = F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: amount(i).cast("string"))
    return view(spark, sf, "v_lists").select(*KEY, n.cast("int").alias("n"), D.difficulty_add_tree(texts_).alias("difficulty"))


# ---- metrics ----

def sql_gap(p: str, t: str) -> str:
    return f"(abs({p} - {t}) / (abs({t}) + abs({p}) + 1e-100))"


def sql_log_smape(p: str, t: str, digits: int = 15) -> str:
    return f"(least(1.0, log10({sql_gap(p, t)} + 1e-100) / -{digits}.0) + 0.0)"


def _preds(spark, sf):
    return view(spark, sf, "v_preds")


PRED_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "truth"]
PRED_SQL = ", ".join(PRED_KEY)


@query("metric_smape", with_views("v_preds") + f"""
SELECT {PRED_SQL}, round(1 - {sql_gap('pred', 'truth')}, 9) AS score, 1 - {sql_gap('pred', 'truth')} > 0.95 AS correct FROM v_preds""")
def metric_smape(spark, sf):
    m = M.metric("sMAPE")
    s = m.score(F.col("pred"), F.col("truth"))
    return _preds(spark, sf).select(*PRED_KEY, F.round(s, 9).alias("score"), m.correct(s).alias("correct"))


@query("metric_logsmape", with_views("v_preds") + f"""
SELECT {PRED_SQL}, round({sql_log_smape('pred', 'truth')}, 9) AS score, round({sql_log_smape('pred', 'truth', 6)}, 9) AS score_32 FROM v_preds""")
def metric_logsmape(spark, sf):
    p, t = F.col("pred"), F.col("truth")
    return _preds(spark, sf).select(
        *PRED_KEY, F.round(M.metric("logSMAPE").score(p, t), 9).alias("score"), F.round(M.metric("logSMAPE_32").score(p, t), 9).alias("score_32")
    )


@query("metric_exact", with_views("v_preds") + f"""
SELECT {PRED_SQL}, abs(pred - truth) < pow(10.0, -least(greatest(14 - ceil(log10(abs(truth) + 1e-100)), 0), 14)) AS correct FROM v_preds""")
def metric_exact(spark, sf):
    return _preds(spark, sf).select(*PRED_KEY, M.exact_number(F.col("pred"), F.col("truth")).alias("correct"))


@query("metric_sigbits", with_views("v_preds") + f"""
SELECT {PRED_SQL}, round(CASE WHEN pred = truth THEN 1.0 ELSE least(greatest(-log2(abs((pred - truth) / (abs(truth) + 1e-100))), 0.0), 53.0) / 53.0 END
  + 0.0, 9) AS score FROM v_preds""")
def metric_sigbits(spark, sf):
    return _preds(spark, sf).select(*PRED_KEY, F.round(M.sig_bits(F.col("pred"), F.col("truth")), 9).alias("score"))


@query("metric_class", """
WITH s AS (SELECT event_type, CASE WHEN user_id % 5 = event_id % 5 THEN 1.0 ELSE 0.0 END + CASE WHEN user_id % 2 = event_id % 2 THEN 1.0 ELSE 0.0 END AS hits
  FROM events)
SELECT event_type, round(avg(hits / 2), 9) AS equality, round(greatest(0.0, (2.8 * avg(hits / 2) - 1) / 1.8), 9) AS class_acc,
  round(greatest(0.0, (2.0 * avg(hits / 2) - 1) / 1.0), 9) AS binary_acc, round(greatest(0.0, (5.0 * avg(hits / 2) - 1) / 4.0), 9) AS quint_acc
FROM s GROUP BY event_type""")
def metric_class(spark, sf):
    t = table(spark, sf, "events")
    hits = M.token_equality(F.array(F.col("user_id") % 5, F.col("user_id") % 2), F.array(F.col("event_id") % 5, F.col("event_id") % 2))
    g = t.groupBy("event_type").agg(F.avg(hits).alias("acc"))
    return g.select(
        "event_type", F.round("acc", 9).alias("equality"), F.round(M.class_acc(F.col("acc")), 9).alias("class_acc"),
        F.round(M.class_acc(F.col("acc"), 2.0), 9).alias("binary_acc"), F.round(M.class_acc(F.col("acc"), 5.0), 9).alias("quint_acc"),
    )


@query("metric_scaled_ppl", """
WITH s AS (SELECT event_type, exp(sum(CAST(value AS DECIMAL(10,2))) / count(*) / 12.0) AS ppl FROM events GROUP BY event_type)
SELECT event_type, round(least(1.0, exp((40 - ppl) / 100)), 9) AS score, round(least(1.0, exp((20 - ppl) / 100)), 9) AS hard_score FROM s""")
def metric_scaled_ppl(spark, sf):
    mean = F.sum(F.col("value").cast("decimal(10,2)")).cast("double") / F.count("*")
    g = table(spark, sf, "events").groupBy("event_type").agg(F.exp(mean / 12.0).alias("ppl"))
    return g.select(
        "event_type", F.round(M.scaled_ppl(F.col("ppl")), 9).alias("score"), F.round(M.scaled_ppl(F.col("ppl"), 20.0), 9).alias("hard_score")
    )


# ---- encodings ----

@query("number_bits", f"""
SELECT {KEY_SQL}, CAST(CAST(l_extendedprice AS DOUBLE) AS BIT)::VARCHAR AS bits64, CAST(CAST(l_extendedprice AS FLOAT) AS BIT)::VARCHAR AS bits32,
  CAST(-1 / l_extendedprice AS BIT)::VARCHAR AS bits_inverse, l_extendedprice AS back FROM lineitem""")
def number_bits(spark, sf):
    t = spread(table(spark, sf, "lineitem").select(*KEY))
    t = t.select(*KEY, E.number_bits("l_extendedprice").alias("bits64"), E.number_bits("l_extendedprice", 32).alias("bits32"),
                 F.right(E.number_bits(-F.col("l_extendedprice"), reciprocal=True), F.lit(64)).alias("bits_inverse"))
    return t.withColumn("back", E.bits_value("bits64"))


@query("bit_profile", """
WITH b AS (SELECT l_returnflag, CAST(CAST(l_extendedprice AS DOUBLE) AS BIT)::VARCHAR AS bits FROM lineitem),
  n AS (SELECT l_returnflag, count(DISTINCT bits) AS n_distinct FROM b GROUP BY ALL),
  p AS (SELECT l_returnflag, bits, unnest(range(1, 65)) AS place FROM b)
SELECT l_returnflag, CAST(place AS INT) AS place, round(avg(CASE WHEN substr(bits, CAST(place AS INT), 1) = '1' THEN 1.0 ELSE 0.0 END), 9) AS share, any_value(n_distinct) AS n_distinct
FROM p JOIN n USING (l_returnflag) GROUP BY l_returnflag, place""")
def bit_profile(spark, sf):
    t = table(spark, sf, "lineitem").select("l_returnflag", E.number_bits("l_extendedprice").alias("bits"))
    return E.bit_profile(t, "bits", ["l_returnflag"]).withColumn("share", F.round("share", 9))


@query("number_digits10", f"""
WITH s AS (SELECT {KEY_SQL}, l_extendedprice AS x, CAST(floor(log10(l_extendedprice)) AS INT) AS e FROM lineitem)
SELECT {KEY_SQL}, '1' || CAST(e + 500 AS VARCHAR) || right('00' || CAST(CAST(round_even(x / pow(10.0, e) * 1e16, 0) AS BIGINT) AS VARCHAR), 17) AS digits FROM s""")
def number_digits10(spark, sf):
    return spread(table(spark, sf, "lineitem").select(*KEY)).select(*KEY, E.number_digits10("l_extendedprice").alias("digits"))


@query("number_fourier", f"""
WITH s AS (SELECT {KEY_SQL}, l_extendedprice AS x, unnest([0.1, 1.0, 10.0, 100.0, 1000.0, 10000.0]) AS period FROM lineitem)
SELECT CAST(period AS DOUBLE) AS period, round(avg(cos(x * (2 * pi() / period))), 6) + 0.0 AS mean_cos, round(avg(sin(x * (2 * pi() / period))), 6) + 0.0 AS mean_sin
FROM s GROUP BY period""")
def number_fourier(spark, sf):
    periods = E.fourier_periods(int_digits=4, frac_digits=2)
    t = table(spark, sf, "lineitem").select(E.number_fourier("l_extendedprice", periods).alias("w"))
    # one pass: the mean of every feature, then one row per period
    means = t.agg(*[F.avg(F.col("w")[i]).alias(f"m{i}") for i in range(2 * len(periods))])
    rows = F.array(*[
        F.struct(F.lit(p).alias("period"), F.col(f"m{2 * i}").alias("c"), F.col(f"m{2 * i + 1}").alias("s")) for i, p in enumerate(periods)
    ])
    return means.select(F.explode(rows).alias("r")).select(
        "r.period", (F.round("r.c", 6) + 0.0).alias("mean_cos"), (F.round("r.s", 6) + 0.0).alias("mean_sin")
    )


@query("number_logscale", f"""
WITH s AS (SELECT {KEY_SQL}, l_extendedprice - 50000 AS x FROM lineitem)
SELECT {KEY_SQL}, round(CASE WHEN abs(x) >= 1e-14 THEN (2.5 / 15.0 * log10(abs(x) + 1e-14) + 2.5) * sign(x) ELSE 0.0 END, 9) AS log_scaled,
  round(least(greatest(x, -1e15), 1e15) * 5e-15 * 1e10, 9) AS linear_scaled FROM s""")
def number_logscale(spark, sf):
    t = table(spark, sf, "lineitem")
    x = F.col("l_extendedprice") - 50000
    return t.select(*KEY, F.round(E.number_logscale(x), 9).alias("log_scaled"), F.round(E.number_logscale(x, "linear") * 1e10, 9).alias("linear_scaled"))


_NOISE_KEY = "concat_ws('-', l_orderkey, l_linenumber, l_partkey)"


def _mask_sql(share: float) -> str:
    """Lines with their keyed mask of flipped bits `mask`, drawn anew from the md5 sums."""
    digest = " || ".join(f"md5('42:' || {_NOISE_KEY} || ':{i}')" for i in range(8))
    limit = f"{round(share * 65536):04x}"
    return f"""drawn AS (SELECT *, {digest} AS h FROM lineitem),
  masked AS (SELECT *, array_to_string([CASE WHEN substr(h, 4 * j + 1, 4) < '{limit}' THEN '1' ELSE '0' END FOR j IN range(64)], '') AS mask FROM drawn)"""


@query("noise_flips", f"""WITH {_mask_sql(0.15)}, p AS (SELECT l_returnflag, mask, unnest(range(1, 65)) AS place FROM masked)
SELECT l_returnflag, CAST(place AS INT) AS place, count(*) AS n, count(*) FILTER (substr(mask, CAST(place AS INT), 1) = '1') AS n_flipped FROM p GROUP BY l_returnflag, place""")
def noise_flips(spark, sf):
    """How often each bit is flipped when three tenths of the symbols are redrawn."""
    t = table(spark, sf, "lineitem").select("l_returnflag", E.flip_mask(F.expr(_NOISE_KEY), E.flip_share(0.3, 0.3)).alias("mask"))
    counts = t.groupBy("l_returnflag").agg(F.count("*").alias("n"), *[F.count_if(F.substr("mask", F.lit(j), F.lit(1)) == "1").alias(f"f{j}") for j in range(1, 65)])
    places = F.array(*[F.struct(F.lit(j).alias("place"), F.col(f"f{j}").alias("n_flipped")) for j in range(1, 65)])
    return counts.select("l_returnflag", "n", F.inline(places))


_BACK = f"""x AS (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice ELSE -l_extendedprice END AS x FROM masked),
  y AS (SELECT x, CAST(xor(CAST(x AS BIT), CAST(mask AS BIT)) AS DOUBLE) AS back FROM x)"""


@query("roundtrip_report", f"""WITH {_mask_sql(0.01)}, {_BACK}
SELECT CAST(floor(log10(abs(x))) AS INT) AS exponent, count(*) AS n,
  round(avg(CASE WHEN NOT isnan(back) AND abs(x - back) <= greatest(1e-6 * greatest(abs(x), abs(back)), 1e-6) THEN 1.0 ELSE 0.0 END), 9) AS accuracy,
  round(avg(CASE WHEN NOT isnan(back) THEN {sql_log_smape('back', 'x')} END), 6) AS mean_log_smape FROM y GROUP BY exponent""")
def roundtrip_report(spark, sf):
    """Amounts of both signs through the bit encoding, two in a hundred symbols redrawn, within a hundred million times the usual tolerance."""
    x = F.col("l_extendedprice") * F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(-1)
    t = spread(table(spark, sf, "lineitem").select(x.alias("x"), F.expr(_NOISE_KEY).alias("key")))
    r = E.roundtrip_report(t, "x", "bits", noise=0.3, bernoulli=0.02, grace=1e8, key="key")
    return r.withColumn("accuracy", F.round("accuracy", 9)).withColumn("mean_log_smape", F.round("mean_log_smape", 6))


@query("roundtrip_encodings")
def roundtrip_encodings(spark, sf):
    # amounts spread over the exponents -14 to 13 by the part key, with both signs
    x = F.col("l_extendedprice") * F.pow(F.lit(10.0), (F.col("l_partkey") % 24 - 14).cast("int")) * F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(-1)
    t = spread(table(spark, sf, "lineitem").select(x.alias("x")))
    out = None
    for name in ("bits", "digits10", "log", "linear"):
        r = E.roundtrip_report(t, "x", name, noise=0.3 if name == "bits" else 0.0).withColumn("encoding", F.lit(name))
        out = r if out is None else out.unionByName(r)
    return out


@query("tokens_per_number", f"""WITH {_TEXTS}, {_FOUND}
SELECT source, count(*) AS n_numbers, CAST(sum(length(regexp_replace(token, '[^0-9]', '', 'g'))) AS BIGINT) AS single_digit,
  CAST(sum(len(regexp_extract_all(token, '[1-9][0-9]{{0,2}}|0'))) AS BIGINT) AS three_digit, count(*) AS number_token, count(*) AS magnitude_token
FROM found GROUP BY source""")
def tokens_per_number(spark, sf):
    found = F.explode(F.regexp_extract_all("text", F.lit(NUMBER), F.lit(0)))
    t = texts(spark, sf).select("source", found.alias("token")).select("source", E.number_tokens("token").alias("n"))
    kinds = ["single_digit", "three_digit", "number_token", "magnitude_token"]
    return t.groupBy("source").agg(F.count("*").alias("n_numbers"), *[F.sum(f"n.{k}").cast("bigint").alias(k) for k in kinds])
