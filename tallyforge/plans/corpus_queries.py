"""Queries on token streams, packed contexts, mixtures, curriculum tables and the score stream."""
from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge import constants as C
from tallyforge.operators import corpus as K
from tallyforge.operators import mixture as M
from tallyforge.plans.number_queries import sql_log_smape, texts
from tallyforge.plans.problem_queries import _folder
from tallyforge.plans.registry import query, spread, table
from tallyforge.plans.views import view, with_views
from tallyforge.session import shared_dir, small_batches
from tallyforge.sources import files as S
from tallyforge.streaming.score_stream import leaderboard, score_stream

WORD = "[^ \\t\\r\\n]+"
LENGTH = 256
EOS = 0


def words(spark, sf):
    """Documents as arrays of word lengths; a word that ends a sentence counts as end token 0."""
    d = spread(table(spark, sf, "documents"))
    w = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    ids = F.transform(w, lambda x: F.when(F.endswith(x, F.lit(".")), EOS).otherwise(F.length(x)))
    return d.select("doc_id", "source", "lang", "n_chars", ids.alias("tokens")).withColumn("n_tokens", F.size("tokens"))


_WORDS = f"""words AS (SELECT doc_id, source, lang, n_chars, [CASE WHEN x LIKE '%.' THEN 0 ELSE CAST(length(x) AS INT) END
  FOR x IN regexp_extract_all(text, '{WORD}')] AS tokens FROM documents),
  sized AS (SELECT *, len(tokens) AS n_tokens FROM words)"""
_STREAM = f"""{_WORDS},
  off AS (SELECT *, CAST(sum(n_tokens) OVER (PARTITION BY source ORDER BY doc_id) - n_tokens AS BIGINT) AS start FROM sized),
  long AS (SELECT source, doc_id, start + i AS pos, token FROM (SELECT source, doc_id, start, unnest(tokens) AS token, unnest(range(len(tokens))) AS i FROM off)),
  ctx AS (SELECT source, pos // {LENGTH} AS context_idx, pos % {LENGTH} AS place, pos, token FROM long),
  packed AS (SELECT source, context_idx, list(token ORDER BY pos) AS tokens FROM ctx GROUP BY ALL HAVING count(*) = {LENGTH})"""


def stream(spark, sf):
    return K.token_offsets(words(spark, sf), ["source"], "doc_id")


def packed(spark, sf):
    return K.pack_contexts(stream(spark, sf), ["source"], ["tokens"], LENGTH)


# ---- samples and tokens ----

_TURNS = """
  u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'),
  s AS (SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS answer FROM u JOIN a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1)"""


def samples(spark, sf):
    """User turns with the assistant turn that follows."""
    c = table(spark, sf, "conversations")
    u = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    a = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return u.join(a, ["conv_id", "turn"])


@query("format_samples", f"WITH {_TURNS} SELECT conv_id, turn, '<|bos|>' || prompt || '<|eoq|>' || answer || '<|eos|>' AS text FROM s")
def format_samples(spark, sf):
    return K.format_samples(samples(spark, sf)).select("conv_id", "turn", "text")


_PIECES = ["tion", "the ", "the", " ", ".", ",", *"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]
_ENTRIES = list(dict.fromkeys([*C.SPECIAL_TOKENS, C.NUM, C.OVERFLOW, *_PIECES]))
_RE2 = "|".join(["<\\|[a-z]+\\|>", "tion", "the ", "the", "[ .,a-zA-Z]", "(?s:.)"])
_LISTED = "[" + ", ".join(f"'{t}'" for t in _ENTRIES) + "]"


@query("tokenize_corpus", f"""
WITH texts AS (SELECT 'documents' AS source, doc_id AS id, text FROM documents UNION ALL SELECT 'pages', page_id, html FROM pages),
  r AS (SELECT source, id, regexp_replace(text, '{C.NUMBER}', '<|num|>', 'g') AS t, regexp_extract_all(text, '{C.NUMBER}') AS n FROM texts),
  k AS (SELECT source, id, n, flatten([CASE WHEN coalesce(list_position({_LISTED}, x), 0) > 0 THEN [list_position({_LISTED}, x) - 1]
      ELSE [{len(_ENTRIES)} + CAST('0x' || substr(hex(x), 2 * i + 1, 2) AS INT) FOR i IN range(strlen(x))] END FOR x IN regexp_extract_all(t, '{_RE2}')]) AS ids FROM r)
SELECT source, id, len(ids) AS n_tokens, md5(array_to_string(ids, ',')) AS ids_md5,
  round(coalesce(list_sum([CAST(x AS DOUBLE) FOR x IN n]), 0), 4) AS number_sum FROM k""")
def tokenize_corpus(spark, sf):
    small_batches(spark)
    vocabulary = K.number_vocabulary(spark, "number", _PIECES, byte_fallback=True)
    t = K.tokenize_numbers(texts(spark, sf), vocabulary)
    total = lambda c, zero: F.aggregate(c, zero, lambda a, x: a + x)
    return t.select(
        "source", "id", F.size("tokens").cast("bigint").alias("n_tokens"), F.md5(F.array_join("tokens", ",")).alias("ids_md5"), F.round(total(F.col("token_numbers"), F.lit(0.0)), 4).alias("number_sum"),
    )


_SAMPLE_TOKENS = f"""{_TURNS},
  t AS (SELECT conv_id, turn, [CAST(10 + length(x) AS INT) FOR x IN regexp_extract_all(prompt, '{WORD}')] AS p, [CAST(10 + length(x) AS INT) FOR x IN regexp_extract_all(answer, '{WORD}')] AS a FROM s)"""


def sample_arrays(spark, sf):
    w = lambda c: F.transform(F.regexp_extract_all(c, F.lit(WORD), F.lit(0)), lambda x: (F.length(x) + 10).cast("int"))
    tokens, labels = K.sample_tokens(w("prompt"), w("answer"), 1, 2, 3)
    return samples(spark, sf).select("conv_id", "turn", tokens.alias("tokens"), labels.alias("labels"))


@query("label_mask", f"""WITH {_SAMPLE_TOKENS}
SELECT conv_id, turn, CAST(len(p) + len(a) + 3 AS INT) AS n_tokens, CAST(len(a) + 1 AS INT) AS n_labels, CAST(coalesce(list_sum(a), 0) + 3 AS BIGINT) AS label_sum FROM t""")
def label_mask(spark, sf):
    t = sample_arrays(spark, sf)
    masked = K.label_mask("tokens", 1, 2)
    kept = F.filter(masked, lambda x: x.isNotNull())
    total = F.aggregate(kept, F.lit(0).cast("bigint"), lambda a, x: a + x)
    # the running-sum mask and the mask built with the sample are the same
    t = t.withColumn("n_labels", F.when(masked == F.col("labels"), F.size(kept)))
    return t.select("conv_id", "turn", F.size("tokens").alias("n_tokens"), "n_labels", total.alias("label_sum"))


@query("token_offsets", f"WITH {_STREAM} SELECT source, doc_id, CAST(n_tokens AS INT) AS n_tokens, start FROM off")
def token_offsets(spark, sf):
    return stream(spark, sf).select("source", "doc_id", "n_tokens", "start")


@query("pack_contexts", f"""WITH {_STREAM}
SELECT source, CAST(context_idx AS BIGINT) AS context_idx, CAST(list_sum(tokens) AS BIGINT) AS token_sum, array_to_string(tokens, ',') AS tokens FROM packed""")
def pack_contexts(spark, sf):
    total = F.aggregate("tokens", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return packed(spark, sf).select("source", "context_idx", total.alias("token_sum"), F.array_join("tokens", ",").alias("tokens"))


@query("appended_tokens", f"""WITH {_STREAM}
SELECT source, CAST(context_idx AS BIGINT) AS context_idx, CAST(list_sum(tokens) AS BIGINT) AS token_sum, array_to_string(tokens, ',') AS tokens FROM packed""")
def appended_tokens(spark, sf):
    """Contexts appended in three chunks, the second of them twice; what is read back is what one write would give."""
    path = f"{_folder(spark, 'appended_tokens')}-{uuid.uuid4().hex}"
    packed(spark, sf).select("source", "context_idx", "tokens").write.parquet(f"{path}/packed")
    t = spark.read.parquet(f"{path}/packed")
    t = t.join(t.groupBy(F.col("source").alias("_s")).agg(F.count("*").alias("_n")), F.col("source") == F.col("_s"))
    t = t.withColumn("chunk", F.floor(F.col("context_idx") * 3 / F.col("_n"))).withColumn("first", F.ceil(F.col("chunk") * F.col("_n") / 3))
    t = t.select("source", (F.col("context_idx") - F.col("first")).alias("context_idx"), "tokens", "chunk")
    for chunk, broken in ((0, False), (1, True), (2, False), (1, False)):
        part = t.filter(F.col("chunk") == chunk).drop("chunk")
        S.append_tokens(part.filter("context_idx % 2 = 0") if broken else part, f"{path}/tokens", chunk)
    total = F.aggregate("tokens", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return S.read_tokens(spark, f"{path}/tokens").select("source", "context_idx", total.alias("token_sum"), F.array_join("tokens", ",").alias("tokens"))


@query("token_table", f"WITH {_STREAM} SELECT source, count(*) AS n_contexts, CAST(sum(list_sum(tokens)) AS BIGINT) AS token_sum FROM packed GROUP BY source")
def token_table(spark, sf):
    path = _folder(spark, "token_table")
    S.write_tokens(packed(spark, sf), path, "overwrite")
    total = F.aggregate("tokens", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return spark.read.parquet(path).groupBy("source").agg(F.count("*").alias("n_contexts"), F.sum(total).alias("token_sum"))


_POS = f"""{_STREAM},
  inside AS (SELECT c.*, sum(CASE WHEN token = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source, context_idx ORDER BY pos) - CASE WHEN token = 0 THEN 1 ELSE 0 END AS seg
    FROM ctx c SEMI JOIN packed USING (source, context_idx)),
  posd AS (SELECT *, row_number() OVER (PARTITION BY source, context_idx, seg ORDER BY pos) - 1 AS position_id FROM inside)"""


@query("position_ids", f"""WITH {_POS} SELECT source, CAST(context_idx AS BIGINT) AS context_idx, string_agg(CAST(position_id AS VARCHAR), ',' ORDER BY pos) AS position_ids
FROM posd GROUP BY ALL""")
def position_ids(spark, sf):
    return packed(spark, sf).select("source", "context_idx", F.array_join(K.position_ids("tokens", EOS), ",").alias("position_ids"))


@query("pack_boundaries", f"""WITH {_POS} SELECT source, CAST(context_idx AS BIGINT) AS context_idx, string_agg(CAST(place AS VARCHAR), ',' ORDER BY pos) FILTER (position_id = 0) || ',{LENGTH}' AS cu_seq_lens,
  CAST(max(position_id) + 1 AS INT) AS max_seq_length FROM posd GROUP BY ALL""")
def pack_boundaries(spark, sf):
    t = packed(spark, sf).withColumn("b", K.pack_boundaries(K.position_ids("tokens", EOS)))
    return t.select("source", "context_idx", F.array_join("b.cu_seq_lens", ",").alias("cu_seq_lens"), "b.max_seq_length")


@query("pad_batches", f"""WITH {_SAMPLE_TOKENS}, n AS (SELECT conv_id, turn, conv_id // 4 AS batch, len(p) + len(a) + 3 AS n FROM t),
  m AS (SELECT *, max(n) OVER (PARTITION BY batch) AS width FROM n)
SELECT conv_id, turn, batch, CAST(width AS INT) AS width, CAST(width - n AS INT) AS n_pad, CAST(n AS INT) AS attended, CAST((width - n) + n * (n - 1) // 2 AS BIGINT) AS position_sum FROM m""")
def pad_batches(spark, sf):
    t = sample_arrays(spark, sf).withColumn("batch", F.floor(F.col("conv_id") / 4))
    t = K.pad_batches(t, "batch", {"tokens": 99, "labels": None}, "tokens")
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    pads = F.size(F.filter("tokens", lambda x: x == 99))
    return t.select("conv_id", "turn", "batch", F.size("labels").alias("width"), pads.alias("n_pad"), total(F.col("attention_mask")).cast("int").alias("attended"),
                    total(F.col("position_ids")).alias("position_sum"))


@query("near_number_mask", f"""
WITH w AS (SELECT page_id, unnest(regexp_extract_all(html, '[0-9.]+|-|[^ 0-9.-]+')) AS token, unnest(range(len(regexp_extract_all(html, '[0-9.]+|-|[^ 0-9.-]+')))) AS pos FROM pages),
  c AS (SELECT page_id, pos // {LENGTH} AS context_idx, pos, token, regexp_full_match(token, '[0-9]+[.]?[0-9]*') AS num FROM w),
  s AS (SELECT *, num OR (token = '-' AND coalesce(lead(num) OVER v, false)) AS signed FROM c WINDOW v AS (PARTITION BY page_id, context_idx ORDER BY pos)),
  n AS (SELECT *, bool_or(signed) OVER (PARTITION BY page_id, context_idx ORDER BY pos ROWS BETWEEN 20 PRECEDING AND 20 FOLLOWING) AND NOT signed AS near FROM s)
SELECT page_id, CAST(context_idx AS BIGINT) AS context_idx, count(*) FILTER (signed) AS n_number, count(*) FILTER (near) AS n_near, count(*) AS n FROM n GROUP BY ALL""")
def near_number_mask(spark, sf):
    w = F.posexplode(F.regexp_extract_all("html", F.lit("[0-9.]+|-|[^ 0-9.-]+"), F.lit(0))).alias("pos", "token")
    t = table(spark, sf, "pages").select("page_id", w).withColumn("context_idx", F.floor(F.col("pos") / LENGTH))
    t = t.withColumn("num", F.col("token").rlike("^[0-9]+[.]?[0-9]*$"))
    t = K.near_number_mask(t, ["page_id", "context_idx"], "pos", "num", "token")
    return t.groupBy("page_id", "context_idx").agg(F.count_if("number_or_sign").alias("n_number"), F.count_if("near_number").alias("n_near"), F.count("*").alias("n"))


# ---- ranges ----

_RANGES = f"""{_WORDS}, lev AS (SELECT *, CAST(least(n_chars // 400, 12) AS INT) AS difficulty FROM sized),
  per AS (SELECT source, difficulty, CAST(sum(n_tokens) AS BIGINT) AS n FROM lev GROUP BY ALL),
  rng AS (SELECT source, difficulty, CAST(sum(n) OVER (PARTITION BY source ORDER BY difficulty) - n AS BIGINT) AS lo, CAST(sum(n) OVER (PARTITION BY source ORDER BY difficulty) AS BIGINT) AS hi FROM per),
  sz AS (SELECT source, CAST(sum(n_tokens) - {LENGTH} AS BIGINT) AS size FROM sized GROUP BY source),
  so AS (SELECT source, CAST(sum(size) OVER (ORDER BY source) - size AS BIGINT) AS source_start, CAST(sum(size) OVER (ORDER BY source) AS BIGINT) AS source_end FROM sz),
  globe AS (SELECT rng.source, difficulty, lo + source_start AS lo, hi + source_start AS hi FROM rng JOIN so USING (source))"""


def _levels(spark, sf):
    return words(spark, sf).withColumn("difficulty", F.least(F.floor(F.col("n_chars") / 400), F.lit(12)).cast("int"))


def _ranges(spark, sf):
    ranges = K.difficulty_ranges(_levels(spark, sf), ["source"])
    offsets = K.source_offsets(words(spark, sf), "source", "n_tokens", LENGTH)
    return ranges, offsets


@query("difficulty_ranges", f"WITH {_RANGES} SELECT rng.source, rng.difficulty, rng.lo, rng.hi, globe.lo AS global_lo, globe.hi AS global_hi FROM rng JOIN globe USING (source, difficulty)")
def difficulty_ranges(spark, sf):
    ranges, offsets = _ranges(spark, sf)
    g = K.global_ranges(ranges, offsets).select("source", "difficulty", F.col("lo").alias("global_lo"), F.col("hi").alias("global_hi"))
    return ranges.join(g, ["source", "difficulty"])


_PROBE = "pr AS (SELECT doc_id, doc_id * 37 AS x FROM documents)"


@query("difficulty_of_position", f"""WITH {_RANGES}, {_PROBE}, hit AS (SELECT pr.doc_id, pr.x, (SELECT max(lo) FROM globe WHERE lo <= pr.x) AS lo FROM pr)
SELECT hit.doc_id, hit.x, CAST(CASE WHEN g.hi >= hit.x THEN g.difficulty ELSE -1 END AS INT) AS difficulty FROM hit LEFT JOIN
  (SELECT lo, max_by(difficulty, source) AS difficulty, max_by(hi, source) AS hi FROM globe GROUP BY lo) g ON g.lo = hit.lo""")
def difficulty_of_position(spark, sf):
    ranges, offsets = _ranges(spark, sf)
    # where two sources' ranges start at one position the later source counts
    g = K.global_ranges(ranges, offsets).groupBy("lo").agg(F.max_by(F.struct("hi", "difficulty"), "source").alias("r")).select("lo", "r.hi", "r.difficulty")
    t = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") * 37).alias("x"))
    return K.lookup_ranges(t, g, "x", "difficulty", "difficulty").select("doc_id", "x", F.coalesce("difficulty", F.lit(-1)).alias("difficulty"))


@query("source_of_position", f"""WITH {_RANGES}, {_PROBE}
SELECT doc_id, x, (SELECT max_by(source, source_start) FROM so WHERE source_start <= x) AS source FROM pr""")
def source_of_position(spark, sf):
    _, offsets = _ranges(spark, sf)
    t = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") * 37).alias("x"))
    return K.lookup_ranges(t, offsets, "x", "source", "source", lo="source_start", hi=None, default=None).select("doc_id", "x", "source")


@query("length_batches", """
WITH r AS (SELECT length(text) AS n, row_number() OVER (ORDER BY length(text)) - 1 AS rn, count(*) OVER () AS total FROM documents)
SELECT rn // 32 AS batch, count(*) AS n, min(r.n) AS shortest, max(r.n) AS longest, rn // 32 >= any_value(total) // 32 AS is_last FROM r GROUP BY rn // 32""")
def length_batches(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", F.length("text").cast("bigint").alias("length"))
    b = K.length_batches(t, 32, ["doc_id"], "length")
    g = b.groupBy("batch").agg(F.count("*").alias("n"), F.min("length").alias("shortest"), F.max("length").alias("longest"), F.max("batch_order").alias("o"))
    return g.withColumn("is_last", (F.col("o") == F.col("batch")) & (F.col("n") < 32)).drop("o")


@query("token_accounting", """
WITH t AS (SELECT source, CASE WHEN text = '' THEN 2 ELSE len(regexp_extract_all(text, '(?s)<\\|[a-z_0-9]+\\|>|[0-9]|.')) + 2 END AS i,
    CASE WHEN n_chars % 5 = 0 THEN 0 ELSE len(regexp_extract_all(lang, '(?s)<\\|[a-z_0-9]+\\|>|[0-9]|.')) END AS o FROM documents)
SELECT source, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, count(*) AS num_samples, round_even(sum(i) / count(*), 1) AS mean_input,
  round_even(sum(o) / count(*), 1) AS mean_output, round_even((sum(i) + sum(o)) / count(*), 1) AS mean_total FROM t GROUP BY source""")
def token_accounting(spark, sf):
    t = spread(table(spark, sf, "documents")).withColumn("prediction", F.when(F.col("n_chars") % 5 == 0, "").otherwise(F.col("lang")))
    return K.token_accounting(t, "source", "text", "prediction")


@query("token_accounting_summary", """
WITH t AS (SELECT source, len(regexp_extract_all(text, '(?s)<\\|[a-z_0-9]+\\|>|[1-9][0-9]{0,2}|0|.')) + 2 AS i, length(lang) AS o FROM documents),
  d AS (SELECT source, sum(i) AS i, sum(o) AS o, count(*) AS n FROM t GROUP BY source)
SELECT count(*) AS datasets, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, CAST(sum(n) AS BIGINT) AS num_samples,
  round(avg(i), 6) AS input_per_dataset, round(avg(o), 6) AS output_per_dataset, round(avg(round_even(i / n, 1)), 6) AS mean_input,
  round(avg(round_even(o / n, 1)), 6) AS mean_output, round(avg(round_even((i + o) / n, 1)), 6) AS mean_total FROM d""")
def token_accounting_summary(spark, sf):
    g = K.accounting_summary(K.token_accounting(spread(table(spark, sf, "documents")), "source", "text", "lang", "triple"))
    return g.select(*[F.round(c, 6).alias(c) if "per_" in c or "mean" in c else F.col(c) for c in g.columns])


# ---- mixtures ----

_SHARES = {"click": 0.3, "view": 0.25, "signup": 0.2, "purchase": 0.15, "error": 0.1}


def _mix_sql(groups: str, weights: str, batch: int, end: str = "max") -> str:
    return f"""
  sh AS (SELECT *, w / sum(w) OVER () AS share FROM ({weights})), sized AS (SELECT {groups}, count(*) AS size FROM t GROUP BY ALL),
  lim AS (SELECT {end}(size / share) AS until FROM sh JOIN sized USING ({groups}) WHERE share > 0),
  eps AS (SELECT {groups}, share, size, unnest(range(greatest(1, ceil(until * share / size))::bigint)) AS epoch FROM sh JOIN sized USING ({groups}), lim WHERE share > 0),
  due AS (SELECT t.*, epoch, round((epoch * size + row_number() OVER (PARTITION BY {groups}, epoch ORDER BY event_id) - 0.5::double) / share, 6) AS due FROM t JOIN eps USING ({groups})),
  slots AS (SELECT due.*, row_number() OVER (ORDER BY due, {groups}) - 1 AS slot FROM due, lim WHERE due <= round(until, 6))
SELECT slot // {batch} AS batch, {groups}, count(*) AS n FROM slots GROUP BY ALL"""


@query("mix_sources", "WITH t AS (SELECT event_id, event_type FROM events), " + _mix_sql(
    "event_type", "SELECT unnest(['click', 'view', 'signup', 'purchase', 'error']) AS event_type, unnest([0.3::double, 0.25, 0.2, 0.15, 0.1]) AS w", 64))
def mix_sources(spark, sf):
    t = M.mix_sources(table(spark, sf, "events").select("event_id", "event_type"), _SHARES, 64, ["event_id"], "event_type")
    return t.groupBy("batch", "event_type").agg(F.count("*").alias("n"))


_TASKW = "tw AS (SELECT task, round(1 - avg(acc), 6) AS w FROM v_history GROUP BY task)"


@query("curriculum_mix", with_views("v_history") + f""", {_TASKW},
  t AS (SELECT event_id, task, difficulty FROM v_history), lv AS (SELECT task, difficulty, count(*) AS n FROM t GROUP BY ALL),
  dw AS (SELECT task, difficulty, 1.0 / (1 + difficulty) AS w FROM lv WHERE task <> 'error' AND difficulty < 10),
  dd AS (SELECT task, difficulty, w / sum(w) OVER (PARTITION BY task) AS d FROM dw),
  wt AS (SELECT lv.task, lv.difficulty, tw.w * CASE WHEN lv.task = 'error' THEN n / sum(n) OVER (PARTITION BY lv.task) ELSE coalesce(d, 0) END AS w
    FROM lv JOIN tw USING (task) LEFT JOIN dd ON dd.task = lv.task AND dd.difficulty = lv.difficulty),""" + _mix_sql("task, difficulty", "SELECT * FROM wt", 128))
def curriculum_mix(spark, sf):
    h = view(spark, sf, "v_history")
    tw = h.groupBy("task").agg(F.round(F.lit(1.0) - F.avg("acc"), 6).alias("weight"))
    dw = h.select("task", "difficulty").distinct().filter("task <> 'error' AND difficulty < 10").withColumn("weight", F.lit(1.0) / (F.col("difficulty") + 1))
    t = M.curriculum_mix(h.select("event_id", "task", "difficulty"), tw, dw, 128, ["event_id"])
    return t.groupBy("batch", "task", "difficulty").agg(F.count("*").alias("n"))


_CONTEXT = 256
_LEVELS = f"""
  tok AS (SELECT event_id, task, difficulty, CASE WHEN difficulty % 5 = 0 THEN 1 ELSE 3 + event_id % 11 END AS n FROM v_history),
  per AS (SELECT task, difficulty, CAST(sum(n) AS BIGINT) AS n FROM tok GROUP BY ALL),
  rng AS (SELECT task, difficulty, sum(n) OVER w - n AS lo, sum(n) OVER w AS hi FROM per WINDOW w AS (PARTITION BY task ORDER BY difficulty)),
  cut AS (SELECT *, ceil(lo / {_CONTEXT}) AS f, greatest(ceil(lo / {_CONTEXT}), hi // {_CONTEXT} - 1) AS l, difficulty < max(difficulty) OVER (PARTITION BY task) AS below FROM rng),
  ctx AS (SELECT task, difficulty, CAST(CASE WHEN f = l AND NOT below THEN greatest(f - 1, 0) ELSE f END AS BIGINT) AS first,
    CAST(l + CASE WHEN f = l AND below THEN 1 ELSE 0 END AS BIGINT) AS last, f = l AS borrowed FROM cut)"""


def _level_contexts(spark, sf):
    """Events as samples of a few tokens, every fifth level with one token each, sorted by level and cut into contexts."""
    n = F.when(F.col("difficulty") % 5 == 0, 1).otherwise(F.col("event_id") % 11 + 3)
    t = view(spark, sf, "v_history").select("task", "difficulty", n.alias("n_tokens"))
    return M.level_contexts(K.difficulty_ranges(t, ["task"]), _CONTEXT)


@query("level_contexts", with_views("v_history") + f",{_LEVELS} SELECT * FROM ctx")
def level_contexts(spark, sf):
    return _level_contexts(spark, sf)


@query("context_curriculum", with_views("v_history") + f""",{_LEVELS},
  t AS (SELECT task, difficulty, unnest(range(first, last)) AS event_id FROM ctx), lv AS (SELECT task, difficulty, count(*) AS n FROM t GROUP BY ALL),
  wt AS (SELECT task, difficulty, length(task) * (1.0 / (1 + difficulty)) / sum(1.0 / (1 + difficulty)) OVER (PARTITION BY task) AS w FROM lv),""" + _mix_sql("task, difficulty", "SELECT * FROM wt", 64))
def context_curriculum(spark, sf):
    """A curriculum over contexts; levels too short for one of their own draw from a neighbour's."""
    t = M.contexts_of_levels(_level_contexts(spark, sf))
    levels = t.select("task", "difficulty").distinct()
    tw = levels.groupBy("task").agg(F.length(F.first("task")).cast("double").alias("weight"))
    mixed = M.curriculum_mix(t, tw, levels.withColumn("weight", F.lit(1.0) / (F.col("difficulty") + 1)), 64, ["context_idx"])
    return mixed.groupBy("batch", "task", "difficulty").agg(F.count("*").alias("n"))


@query("missing_difficulties", with_views("v_history") + """,
  need AS (SELECT u.task, d.difficulty FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS task FROM v_history) u CROSS JOIN (SELECT unnest(range(20)) AS difficulty) d)
SELECT task, CAST(difficulty AS INT) AS difficulty FROM need EXCEPT SELECT CAST(user_id AS VARCHAR), difficulty FROM v_history""")
def missing_difficulties(spark, sf):
    # every user should have every level
    h = view(spark, sf, "v_history").select(F.col("user_id").cast("string").alias("task"), "difficulty")
    need = h.select("task").distinct().select("task", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("difficulty"))
    return M.missing_difficulties(need, h)


@query("recent_performance", with_views("v_history") + """
SELECT event_id, task, difficulty, round(avg(acc) OVER (PARTITION BY task, difficulty ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 9) AS recent FROM v_history""")
def recent_performance(spark, sf):
    t = M.recent_performance(view(spark, sf, "v_history").select("event_id", "task", "difficulty", "acc"), 5, order="event_id")
    return t.select("event_id", "task", "difficulty", F.round("recent", 9).alias("recent"))


_FRONT = """
  lv AS (SELECT DISTINCT task, difficulty FROM v_history), fr AS (SELECT task, CAST(3 + length(task) % 4 AS INT) AS frontier FROM lv GROUP BY task),
  rk AS (SELECT *, row_number() OVER (PARTITION BY task, difficulty ORDER BY event_id DESC) AS rn FROM v_history)"""


def _frontier(spark, sf):
    h = view(spark, sf, "v_history").select("event_id", "task", "difficulty", "acc")
    levels = h.select("task", "difficulty").distinct()
    return h, levels, levels.groupBy("task").agg((F.lit(3) + F.length(F.first("task")) % 4).cast("int").alias("frontier"))


@query("frontier_advance", with_views("v_history") + f""",{_FRONT},
  p AS (SELECT task, difficulty, avg(acc) FILTER (rn <= 3) AS recent, count(*) FILTER (rn <= 10) AS n FROM rk GROUP BY ALL),
  f AS (SELECT task, min(difficulty) AS lo, max(difficulty) AS hi, count(*) AS levels FROM lv GROUP BY task),
  j AS (SELECT lv.task, lv.difficulty, frontier, hi, lo, levels, p.recent, p.n FROM lv JOIN fr USING (task) JOIN f USING (task) LEFT JOIN p ON p.task = lv.task AND p.difficulty = lv.difficulty),
  g AS (SELECT task, any_value(frontier) AS frontier, any_value(hi) AS hi,
    coalesce(bool_and(coalesce(recent, 0) >= 0.9 * CASE WHEN 0.6 <= difficulty / hi THEN 1.0 WHEN 0.6 <= difficulty / hi + 0.5 THEN 1 - (0.6 - difficulty / hi) / 0.5 ELSE 0 END)
      FILTER (difficulty <= frontier AND difficulty >= greatest(lo, frontier - 2)), false) AND coalesce(sum(n), 0) >= 3 AS mastered,
    max(difficulty) FILTER (difficulty > frontier AND difficulty <= least(frontier + greatest(1, round_even(levels * 0.1, 0)), hi)) AS nxt FROM j GROUP BY task)
SELECT task, frontier, mastered, CASE WHEN mastered THEN coalesce(nxt, frontier) ELSE frontier END AS new_frontier, mastered AND frontier >= hi AS finished FROM g""")
def frontier_advance(spark, sf):
    h, levels, frontier = _frontier(spark, sf)
    t = M.frontier_advance(h, levels, frontier, 0.9, window=3, k=3, step_fraction=0.1, progress=0.6, order="event_id")
    return t.drop("hi")


@query("difficulty_ratios", with_views("v_history") + f""",{_FRONT},
  p AS (SELECT task, difficulty, avg(acc) FILTER (rn <= 5) AS recent FROM rk GROUP BY ALL),
  j AS (SELECT lv.task, lv.difficulty, frontier, coalesce(recent, 0) AS recent, lv.difficulty <= frontier AS known FROM lv JOIN fr USING (task) LEFT JOIN p ON p.task = lv.task AND p.difficulty = lv.difficulty),
  a AS (SELECT *, pow(greatest(1 - recent, 0.01), 2) AS r FROM j),
  b AS (SELECT *, CASE WHEN known THEN greatest(r / sum(r) FILTER (known) OVER (PARTITION BY task), 0.1 / count(*) FILTER (known) OVER (PARTITION BY task)) END AS r2,
    CASE WHEN NOT known THEN pow(0.5, difficulty - frontier) END AS v FROM a)
SELECT task, difficulty, round(CASE WHEN known THEN r2 / sum(r2) OVER (PARTITION BY task) * 0.9 ELSE v / sum(v) OVER (PARTITION BY task) * 0.1 END, 9) AS ratio FROM b""")
def difficulty_ratios(spark, sf):
    h, levels, frontier = _frontier(spark, sf)
    t = M.difficulty_ratios(h, levels, frontier, p=-1.0, k=5, floor=0.1, preview=0.1, decay=0.5, order="event_id")
    return t.withColumn("ratio", F.round("ratio", 9))


def _capped_sql() -> str:
    """Caps of 0.3 over per-user weights of five event types: fixed rounds of scaling and clipping."""
    rounds = ["c0 AS (SELECT user_id, event_type, w, false AS full_ FROM wt)"]
    for i in range(1, 6):
        rounds.append(
            f"c{i} AS (SELECT user_id, event_type, w, full_ OR w * (1 - 0.3 * sum(CASE WHEN full_ THEN 1 ELSE 0 END) OVER u) > 0.3 * sum(CASE WHEN full_ THEN 0 ELSE w END) OVER u AS full_ "
            f"FROM c{i - 1} WINDOW u AS (PARTITION BY user_id))"
        )
    return ", ".join(rounds)


_CAPPED = f"""WITH wt AS (SELECT user_id, event_type, CAST(sum(CAST(value AS DECIMAL(10,2))) AS DOUBLE) AS w FROM events GROUP BY ALL), {_capped_sql()},
  capped AS (SELECT user_id, event_type, CASE WHEN full_ THEN 0.3 ELSE w * (1 - 0.3 * sum(CASE WHEN full_ THEN 1 ELSE 0 END) OVER u) / sum(CASE WHEN full_ THEN 0 ELSE w END) OVER u END AS capped FROM c5 WINDOW u AS (PARTITION BY user_id))"""


def _capped(spark, sf):
    """Users whose caps cannot sum to 1 keep every weight at its cap."""
    t = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.sum(F.col("value").cast("decimal(10,2)")).cast("double").alias("weight"))
    return M.capped_weights(t.withColumn("cap", F.lit(0.3)), keys=["user_id"])


@query("capped_weights", f"""{_CAPPED}
SELECT user_id, event_type, round(capped, 6) AS capped FROM capped""")
def capped_weights(spark, sf):
    return _capped(spark, sf).select("user_id", "event_type", F.round("capped", 6).alias("capped"))


@query("blended_ratios", f"""{_CAPPED}
SELECT user_id, event_type, round(0.9 / count(*) OVER (PARTITION BY user_id) + 0.1 * capped, 6) AS ratio FROM capped""")
def blended_ratios(spark, sf):
    """Equal ratios of a user's kinds of event, moved a tenth of the way to the capped ones."""
    t = _capped(spark, sf).withColumn("old", F.lit(1.0) / F.count("*").over(Window.partitionBy("user_id")))
    return M.blend(t, "old", "capped", 0.9).select("user_id", "event_type", F.round("ratio", 6).alias("ratio"))


_LOSS = """
  h AS (SELECT task, difficulty AS idx, round(avg(1 - acc), 6) AS loss, count(*) AS n FROM v_history GROUP BY ALL),
  l AS (SELECT *, CASE WHEN idx % 7 = 3 THEN 0.0 ELSE loss END AS used, 0.5 + idx % 3 AS weight, n / sum(n) OVER (PARTITION BY task) AS ratio, 2.0 AS scale FROM h),
  d AS (SELECT *, used / (weight * ratio) AS de, max(idx) OVER (PARTITION BY task) AS top FROM l),
  w AS (SELECT *, CASE WHEN idx = top THEN weight WHEN de <> 0 THEN max(CASE WHEN idx = top THEN scale * de END) OVER (PARTITION BY task) / de END AS nw FROM d)"""


def _losses(spark, sf):
    h = view(spark, sf, "v_history").groupBy("task", F.col("difficulty").alias("idx")).agg(F.round(F.avg(F.lit(1.0) - F.col("acc")), 6).alias("loss"), F.count("*").alias("n"))
    ratio = F.col("n") / F.sum("n").over(Window.partitionBy("task"))
    return h.select("task", "idx", F.when(F.col("idx") % 7 == 3, 0.0).otherwise(F.col("loss")).alias("loss"), (F.col("idx") % 3 + 0.5).cast("double").alias("weight"), ratio.alias("ratio"), F.lit(2.0).alias("scale"))


@query("loss_weights", with_views("v_history") + f""",{_LOSS}
SELECT task, idx, round(last_value(nw IGNORE NULLS) OVER (PARTITION BY task ORDER BY idx), 6) AS new_weight FROM w""")
def loss_weights(spark, sf):
    return M.loss_weights(_losses(spark, sf), keys=["task"]).select("task", "idx", F.round("new_weight", 6).alias("new_weight"))


@query("standby_split", with_views("v_history") + """,
  t AS (SELECT task, difficulty AS idx, round(count(*) / sum(count(*)) OVER (PARTITION BY task), 9) AS ratio, CASE difficulty % 3 WHEN 0 THEN 'standby' WHEN 1 THEN 'standard' ELSE 'curriculum' END AS type
    FROM v_history GROUP BY task, difficulty)
SELECT task, idx, type, round(CASE WHEN type = 'standby' THEN 0.1 * lead(ratio) OVER w WHEN lag(type) OVER w = 'standby' THEN 0.9 * ratio ELSE ratio END, 9) AS true_ratio
FROM t WINDOW w AS (PARTITION BY task ORDER BY idx)""")
def standby_split(spark, sf):
    kind = F.when(F.col("idx") % 3 == 0, "standby").when(F.col("idx") % 3 == 1, "standard").otherwise("curriculum")
    g = view(spark, sf, "v_history").groupBy("task", F.col("difficulty").alias("idx")).agg(F.count("*").alias("n"))
    share = F.round(F.col("n") / F.sum("n").over(Window.partitionBy("task")), 9)
    t = M.standby_split(g.withColumn("ratio", share).withColumn("type", kind), keys=["task"])
    return t.select("task", "idx", "type", F.round("true_ratio", 9).alias("true_ratio"))


@query("forward_fill", """
WITH t AS (SELECT event_id, event_type, CASE WHEN user_id % 4 = 0 THEN NULL WHEN user_id % 4 = 1 THEN 'Infinity'::DOUBLE WHEN user_id % 4 = 2 THEN 'NaN'::DOUBLE ELSE value END AS v FROM events)
SELECT event_id, event_type, last_value(CASE WHEN isfinite(v) THEN v END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY event_id) AS v FROM t""")
def forward_fill(spark, sf):
    u = F.col("user_id") % 4
    v = F.when(u == 0, None).when(u == 1, float("inf")).when(u == 2, float("nan")).otherwise(F.col("value"))
    return M.forward_fill(table(spark, sf, "events").select("event_id", "event_type", v.alias("v")), "v", "event_id", ["event_type"])


@query("interpolate_steps", """
WITH k AS (SELECT event_type, event_id AS s, value AS v, lag(event_id) OVER w AS s0, lag(value) OVER w AS v0 FROM events WHERE user_id % 5 = 0 WINDOW w AS (PARTITION BY event_type ORDER BY event_id)),
  e AS (SELECT *, unnest(range(CASE WHEN s0 IS NULL THEN 0 ELSE s0 + 1 END, s + 1)) AS step FROM k)
SELECT event_type, step, round(CASE WHEN s0 IS NULL OR step = s THEN v ELSE v0 + (v - v0) * (step - s0) / (s - s0) END, 9) AS v FROM e""")
def interpolate_steps(spark, sf):
    # evaluations happen at the events of every fifth user; all steps in between are filled
    t = table(spark, sf, "events").select("event_type", F.col("event_id").alias("step"), F.when(F.col("user_id") % 5 == 0, F.col("value")).alias("v"))
    return M.interpolate_steps(t, "v", "step", ["event_type"]).withColumn("v", F.round("v", 9))


@query("endgame_switch", with_views("v_history") + """,
  g AS (SELECT task, row_number() OVER (ORDER BY task) - 1 AS idx, count(*) AS n, avg(acc) AS acc FROM v_history GROUP BY task),
  t AS (SELECT *, round(n / sum(n) OVER (), 9) AS ratio, CASE idx % 2 WHEN 0 THEN 'curriculum' ELSE 'endgame' END AS type, acc > 0.385 AND idx % 2 = 0 AS finished FROM g),
  l AS (SELECT *, type = 'curriculum' AND finished AND coalesce(lead(type) OVER w = 'endgame', false) AS leaves,
    type = 'endgame' AND coalesce(lag(type) OVER w = 'curriculum' AND lag(finished) OVER w, false) AS enters, lag(ratio) OVER w AS before FROM t WINDOW w AS (ORDER BY idx))
SELECT task, CAST(idx AS INT) AS idx, CASE WHEN leaves THEN 'standby' WHEN enters THEN 'standard' ELSE type END AS type,
  round(CASE WHEN leaves THEN ratio * 0.1 WHEN enters THEN before * 0.9 ELSE ratio END, 9) AS ratio, NOT (type = 'curriculum' AND finished AND NOT leaves) AS difficulty_sampling FROM l""")
def endgame_switch(spark, sf):
    g = view(spark, sf, "v_history").groupBy("task").agg(F.count("*").alias("n"), F.avg("acc").alias("acc"))
    one = Window.partitionBy(F.lit(0))
    t = g.withColumn("idx", F.row_number().over(one.orderBy("task")) - 1).withColumn("ratio", F.round(F.col("n") / F.sum("n").over(one), 9))
    t = t.withColumn("type", F.when(F.col("idx") % 2 == 0, "curriculum").otherwise("endgame"))
    done = t.select("task", ((F.col("acc") > 0.385) & (F.col("idx") % 2 == 0)).alias("finished"))
    return M.endgame_switch(t.select("idx", "task", "type", "ratio"), done).withColumn("ratio", F.round("ratio", 9))


# ---- stream ----

def answers_of_events(events):
    """Events read as model answers: the value is the truth, every third user answers one cent off."""
    text = F.col("value").cast("decimal(10,2)").cast("string")
    wrong = (F.col("value").cast("decimal(10,2)") + F.lit("0.01").cast("decimal(3,2)")).cast("string")
    return events.select(
        F.col("event_id"), F.col("ts").cast("timestamp").alias("ts"), F.lit("Addition").alias("task"), F.col("event_type").alias("model"),
        F.when(F.col("user_id") % 2 == 0, "low").otherwise("none").alias("reasoning"), text.alias("answer"),
        F.concat(F.lit('{"answer": '), F.when(F.col("user_id") % 3 == 0, wrong).otherwise(text), F.lit("}")).alias("raw_response"),
    )


@query("score_stream", f"""
WITH t AS (SELECT event_type AS model, CASE WHEN user_id % 2 = 0 THEN 'low' ELSE 'none' END AS reasoning, CAST(CAST(value AS DECIMAL(10,2)) AS DOUBLE) AS a,
  CAST(CAST(value AS DECIMAL(10,2)) + CASE WHEN user_id % 3 = 0 THEN 0.01 ELSE 0 END AS DOUBLE) AS p FROM events)
SELECT model, reasoning, 'Addition' AS task, round(avg({sql_log_smape('p', 'a')}), 6) AS mean_performance, count(*) AS n_samples FROM t GROUP BY model, reasoning""")
def score_stream_query(spark, sf):
    """Events arrive in files, some of them twice, and in two runs; the sums kept beside the scored rows give the leaderboard."""
    out = f"{shared_dir(spark)}/score-stream-{uuid.uuid4().hex}"
    events = table(spark, sf, "events")
    for run in range(2):
        # the second run brings its own half, and a third of the first half again
        part = events.filter((F.col("event_id") % 2 == run) | (F.lit(run == 1) & (F.col("event_id") % 6 == 0)))
        part.repartition(3, "event_id").write.mode("append").parquet(f"{out}/arriving")
        arriving = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{out}/arriving")
        score_stream(answers_of_events(arriving), out, ["event_id"]).awaitTermination()
    return leaderboard(spark, out).select("model", "reasoning", "task", F.round("mean_performance", 6).alias("mean_performance"), "n_samples")
