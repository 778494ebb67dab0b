"""Edge rules of number text, parsing and metrics on hand-made rows."""
import json
import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge import constants as C
from tallyforge.functions import answers as A
from tallyforge.functions import difficulty as D
from tallyforge.functions import encode as E
from tallyforge.functions import metrics as M
from tallyforge.functions import text as T
from tallyforge.operators import draw as W


def column(spark, values, kind, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def plain_text(v):
    r = repr(v)
    if "e" in r:
        from decimal import Decimal
        r = format(Decimal(r), "f")
    return r.rstrip("0").rstrip(".") if "." in r else r


DOUBLES = [0.0, 1.0, 100.0, 1e-7, 12345678.5, 1e14, 2.5e-14, 0.1, 1 / 3, 123456789012345.6, -0.5, 5e-10, 9.007199254740993e15, 2.0**-40, 1e22]


def test_fixed_point(spark):
    assert column(spark, DOUBLES, "double", T.fixed_point) == [plain_text(v) for v in DOUBLES]


def test_float_text_is_repr(spark):
    values = [*DOUBLES, 1e16, 1e-5, 1.5e300, -2e-7]
    assert column(spark, values, "double", A.float_text) == [repr(v) for v in values]


def test_numbers_in_text(spark):
    texts = ["007.5", "5-3", ".25", "0", "1. 2", "00.5", "a12b-7.50", "", "1.2.3", "x-y 10"]
    want = [[0, 0, 7.5], [5, -3], [0.25], [0], [1, 2], [0, 0.5], [12, -7.5], [], [1.2, 0.3], [10]]
    assert column(spark, texts, "string", T.extract_numbers) == want
    lookahead = re.compile(r"-?(?:0(?![.][0-9])|[0-9]*[.][0-9]+|[1-9][0-9]*)")
    rng = random.Random(5)
    for _ in range(5000):
        s = "".join(rng.choice("0123456789.-a ") for _ in range(12))
        assert re.findall(C.NUMBER, s) == lookahead.findall(s)


def test_replace_numbers(spark):
    out = column(spark, ["a 1 b -2.5", "none", "0"], "string", T.replace_numbers)
    assert [o.text for o in out] == ["a <|num|> b <|num|>", "none", "<|num|>"]
    mag = column(spark, ["x 1 y", "-1e"], "string", lambda c: T.replace_numbers(c, magnitude=True))
    edges = C.magnitude_edges()
    assert mag[0].text == f"x <|num_{sum(e <= 1 for e in edges)}|> y" and len(edges) == 255


def test_split_large_numbers(spark):
    texts = ["1234567890123456789.5", "7 0.1234567890123456789", "1234567890123456", "-98765432109876543210", "12.5"]
    got = column(spark, texts, "string", T.split_large_numbers)
    assert got[2] == [1234567890123456.0] and got[4] == [12.5]
    assert got[0] == [1234567890123450000.0, 6789.5]
    assert got[1] == [7.0, 0.123456789012345, 0.0000000000000006789]
    assert got[3] == [-98765432109876500000.0, -43210.0]


@pytest.mark.parametrize("d", [1, 3, 7, 15])
def test_round_sig_matches_text_rounding(spark, d):
    rng = random.Random(d)
    values = [f"{rng.uniform(1, 10):.14f}e{rng.randint(-12, 13)}" for _ in range(200)] + ["0", "-2.5", "9.99999"]
    values = [plain_text(float(v)) for v in values]
    got = column(spark, values, "string", lambda c: T.round_sig(c, d))
    for text, g in zip(values, got):
        # engines may differ on numbers whose scaled value is within one float step of a tie
        assert g == W.round_texts([float(text)], d)[0] or abs(float(g) - float(text)) <= 0.51 * 10.0 ** (math.floor(math.log10(abs(float(text)))) - d + 1)


def test_bits_and_digits_round_trip(spark):
    values = [1e14, -5.0, -1.000001, 0.999999999, math.pi, 0.0, 1e-7, 5e-324, 1e-310, 1.7e308, float("inf"), -float("inf"), 2.0**-1022]
    assert column(spark, values, "double", lambda c: E.bits_value(E.number_bits(c))) == values
    import struct
    want = ["".join(f"{b:08b}" for b in struct.pack(">d", v)) for v in values]
    assert column(spark, values, "double", E.number_bits) == want
    assert column(spark, [1.5, 1e-40, 65504.0, 1e-7], "double", lambda c: E.number_bits(c, 16))[0] == "0011111000000000"
    import numpy as np
    halves = [1.5, 65504.0, 65519.0, 65520.0, 6e-8, 1e-7, 0.1, -3.14159]
    want16 = [f"{int(np.float16(v).view(np.uint16)):016b}" for v in halves]
    assert column(spark, halves, "double", lambda c: E.number_bits(c, 16)) == want16
    back = column(spark, [1e14, -5.0, math.pi, 1e-7, 0.0], "double", lambda c: E.digits10_value(E.number_digits10(c)))
    assert all(math.isclose(a, b, rel_tol=1e-14) for a, b in zip(back, [1e14, -5.0, math.pi, 1e-7, 0.0]))


def test_roundtrip_report(spark):
    report = {r.exponent: r for r in E.roundtrip_report(E.roundtrip_values(spark, per_exponent=20), "x", "bits", 0.3).collect()}
    assert all(r.accuracy == 1.0 for r in report.values()) and len(report) >= 28


def test_bits_of_every_kind_of_number(spark):
    """Subnormal numbers, zeros of both signs, infinities: the same bits as the machine's, at three widths, and back."""
    import struct

    values = [5e-324, -5e-324, 2.2e-308, 1.0, -0.0, 0.0, math.inf, -math.inf, 1.7976931348623157e308, 1e-45, 3.4e38, 65504.0, 6e-8, -2.5e-7, 6.1e-5, 0.1]
    for width, code in ((64, ">d"), (32, ">f"), (16, ">e")):
        fits = [v for v in values if width == 64 or abs(v) < (1e38 if width == 32 else 65000) or math.isinf(v)]
        want = ["".join(f"{b:08b}" for b in struct.pack(code, v)) for v in fits]
        assert column(spark, fits, "double", lambda c: E.number_bits(c, width)) == want
        back = column(spark, want, "string", lambda c: E.bits_value(c, width))
        assert [struct.pack(">d", v) for v in back] == [struct.pack(">d", struct.unpack(code, struct.pack(code, v))[0]) for v in fits]
    assert column(spark, [math.nan], "double", E.number_bits) == ["0" + "1" * 12 + "0" * 51]
    assert column(spark, [None], "double", E.number_bits) == [None]


def test_noise_on_every_encoding(spark):
    assert E.flip_share(0.3, 0.0) == 0 and E.flip_share(2.0, 0.0) == 0.25 and E.flip_share(0.0, 0.5) == 0.25
    masks = column(spark, [str(i) for i in range(400)], "string", lambda c: E.flip_mask(c, 0.25))
    assert 0.24 < sum(m.count("1") for m in masks) / 25600 < 0.26 and len(set(masks)) == 400 and {len(m) for m in masks} == {64}
    df = E.roundtrip_values(spark, per_exponent=30)
    of = lambda **more: {r.exponent: r for r in E.roundtrip_report(df, "x", **more).collect()}[3]
    assert of(encoding="bits", noise=0.9).accuracy == 1 and of(encoding="bits", noise=1.5).accuracy < 0.2 > of(encoding="bits", bernoulli=0.3).accuracy
    loose = dict(encoding="log", rel_tol=0.05)
    assert of(**loose).accuracy > of(**loose, noise=0.2).accuracy and of(**loose).accuracy > of(**loose, bernoulli=0.6).accuracy
    assert of(**loose, grace=10).accuracy == 1 and of(**loose, noise=0.05, grace=30).accuracy > of(**loose, noise=0.05).accuracy
    assert of(**loose, clamp=1.0).accuracy == 0  # nearly all values lie beyond the clamp


def test_schema_violation(spark):
    number = {"type": "object", "properties": {"answer": {"type": "number"}}, "required": ["answer"], "additionalProperties": False}
    list_ = {**number, "properties": {"answer": {"type": "array", "items": {"type": "number"}}}}
    letter = {**number, "properties": {"answer": {"type": "string", "enum": ["A", "B"]}}}
    texts = [None, "", "x", "[1]", "{}", '{"answer": 1, "b": 2}', '{"answer": "1"}', '{"answer": 1e400}', '{"answer": -2.5}', '{"answer": null}']
    want = ["not_json", "not_json", "not_json", "not_object", "missing_field", "extra_field", "wrong_type"]
    got = column(spark, texts, "string", lambda c: A.schema_violation(c, number))
    assert got[:7] == want and got[8:] == [None, "wrong_type"]
    assert column(spark, ['{"answer": []}', '{"answer": [1, 2.5, 1e3]}', '{"answer": [1, "2"]}', '{"answer": [null]}', '{"answer": {"a": 1}}'], "string", lambda c: A.schema_violation(c, list_)) == [None, None, "wrong_item", "wrong_item", "wrong_type"]
    assert column(spark, ['{"answer": "A"}', '{"answer": "a"}', '{"answer": 1}'], "string", lambda c: A.schema_violation(c, letter)) == [None, "not_in_enum", "wrong_type"]


def test_answer_span():
    import time

    def plain(text):
        for start in (i for i, c in enumerate(text) if c == "{"):
            depth = 0
            for i in range(start, len(text)):
                depth += {"{": 1, "}": -1}.get(text[i], 0)
                if depth == 0:
                    if '"answer"' in text[start : i + 1] or "'answer'" in text[start : i + 1]:
                        return text[start : i + 1]
                    break
        return None

    import random
    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choice(["{", "}", '"answer"', "'answer'", "\"answer'", " x", "1"]) for _ in range(rng.randrange(14)))
        assert A.answer_span(text) == plain(text), text
    begun = time.perf_counter()
    assert A.answer_span("{" * 200_000 + ' "answer" ') is None and A.answer_span("{" * 100_000 + '{"answer": 1}' + "}" * 50_000).startswith("{{{")
    assert time.perf_counter() - begun < 3


def test_difficulty_add_tree_of_any_length(spark):
    add = lambda values: column(spark, [values], "array<string>", D.difficulty_add_tree)[0]
    assert add(["5"]) == 0 and add([]) is None and add(["1", "x"]) is None
    assert add(["1", "2", "3", "4"]) == column(spark, [("3", "7", "10")], "struct<a:string,b:string,c:string>", lambda c: D.difficulty_add([c["a"], c["b"]], c["c"]))[0]
    assert add(["0.1", "0.2", "-0.3"]) == column(spark, [("0.1", "-0.1", "0")], "struct<a:string,b:string,c:string>", lambda c: D.difficulty_add([c["a"], c["b"]], c["c"]))[0]
    assert add([str(i) for i in range(1, 41)]) is not None


def test_base_texts(spark):
    assert column(spark, [0.15625, -5.0, 8.0, 0.0], "double", T.base2_text) == ["0.00101", "-101", "1000", "0.0"]
    assert column(spark, ["101.101", "-11", "0"], "string", lambda c: T.base_value(c, 2)) == [5.625, -3.0, 0.0]


RESPONSES = [
    ("Addition", '{"answer": 1.50}', "1.5"), ("MinMax", '{"answer": 1.50}', "1.50"), ("Addition", '```json\n{"answer": 7}\n```', "7"),
    ("Addition", 'x {"answer": 2} y', "2"), ("Addition", "Answer: 7", "7.0"), ("Interval", "B", "B"), ("Interval", "the answer is (c)", "C"),
    ("Sorting", "[3, 1]", "3.0"), ("Sorting", '{"answer": [3, 1.50]}', "['3', '1.50']"), ("Addition", "", ""), ("Addition", None, ""),
    ("Addition", '{"note": 1} {"answer": 5}', "1.0"), ("Interval", '{"a": {}} {"answer": "D"}', "D"), ("Interval", '{"answer": "b", "why": "x"}', "b"),
    ("Addition", '{"answer": {"x": 1}}', "{'x': 1}"), ("Addition", '{"answer": null}', "None"), ("Addition", "no digits", ""), ("Addition", '{"answer": 1e20}', "1e+20"),
    ("Sorting", '{"answer": []}', "[]"), ("Addition", "-.5e1", "-5.0"), ("Interval", "<thought>A</thought> E", "E"), ("Interval", "{'answer': \"F\"}", "F"),
]


def ladder(task, response):
    """Plain-Python reading of the same rules."""
    def number(t):
        m = re.search(C.ANSWER_NUMBER, t)
        return str(float(m.group())) if m else ""

    def base(t):
        try:
            o = json.loads(t, parse_float=str, parse_int=str) if task in ("MinMax", "Sorting") else json.loads(t)
            if isinstance(o, dict) and "answer" in o:
                return str(o["answer"])
        except ValueError:
            pass
        return number(t)

    if response is None:
        return ""
    if response.count("{") == 1 and response.count("}") == 1:
        response = "{" + response.split("{")[1].split("}")[0] + "}"
    return base(response)


def test_parse_ladder(spark):
    df = spark.createDataFrame([(i, t, r) for i, (t, r, _) in enumerate(RESPONSES)], "i int, task string, raw_response string")
    got = {r.i: r for r in A.parse_answer(df).collect()}
    for i, (task, response, want) in enumerate(RESPONSES):
        assert got[i].parsed_answer == want, (task, response, got[i].parsed_answer)
        first = ladder(task, response)
        if first:
            assert got[i].parsed_answer == first
    assert got[10].reason == "non_string_response" and got[16].reason == "unparseable" and not got[16].ok


def test_scores(spark):
    rows = [
        ("Addition", "1.5", "1.5", 1.0, 1), ("Addition", "-1.5", "1.5", 0.0, 0), ("Addition", "", "2", 0.0, 0), ("Addition", "inf", "2", 0.0, 0),
        ("Interval", "b", "B", 1.0, 0), ("Interval", "A", "B", 0.0, 0), ("Sorting", "['1', '2.50']", "1, 2.5", 1.0, 0), ("Sorting", "[1]", "1, 2", 0.0, 0),
        ("MinMax", "1.50", "1.5", 0.0, 0), ("MinMax", '"1.5"', "1.5", 1.0, 0), ("Mean", "123456789012345678", "123456789012345999", None, 1),
        ("Std", "1e3", "1000", 1.0, 1), ("Std", "0.00120", "1.2e-3", 1.0, 1),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, task string, parsed_answer string, answer string, want double, e int")
    for r in A.score_answers(df).collect():
        assert r.exact15 == r.e, r
        if r.want is not None:
            assert abs(r.performance - r.want) < 1e-9, r


def test_strict_json(spark):
    texts = ['{"answer": 1}', ' {"a": [1, {"b": 2}]} ', '{"answer": 1} tail', "[1]", "{bad}", "", None, '{"a": 1} {"b": 2}', '{"a": "}"}', "```{}```", '{"a": 1}, {"b": 2}']
    want = [True, True, False, False, False, False, False, False, True, False, False]
    assert column(spark, texts, "string", A.is_strict_json) == want


def test_usage(spark):
    u = ['{"reasoning_tokens": 5, "completion_tokens": 7}', '{"completion_tokens": "7.9"}', '{"completion_tokens_details": {"reasoning_tokens": 3}}', "{}", None]
    assert column(spark, u, "string", A.usage_tokens) == [5, 7, 3, -1, -1]
    assert column(spark, u, "string", A.usage_flat)[2] == {"completion_tokens_details.reasoning_tokens": "3"}


def test_metric_edges(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (1.0, -1.0), (float("nan"), 1.0), (float("inf"), 1.0)], "p double, t double")
    got = [(r.a, r.b, r.c) for r in df.select(M.smape(F.col("p"), F.col("t")).alias("a"), M.log_smape(F.col("p"), F.col("t")).alias("b"), M.sig_bits(F.col("p"), F.col("t")).alias("c")).collect()]
    assert got[0] == (1.0, 1.0, 1.0) and got[1] == (1.0, 1.0, 1.0) and got[2] == (0.0, 0.0, 0.0) and got[3][:2] == (0.0, 0.0) and got[4][1] == 0.0
    M.register_metric("half", lambda p, t: F.lit(0.5), 0.4)
    assert M.metric("half").threshold == 0.4
    with pytest.raises(ValueError):
        M.metric("absent")


def slow_add(ops, total):
    top = next(o for o in ops if abs(float(o)) == max(abs(float(x)) for x in ops)).replace(".", "")
    clean, total = [o.replace(".", "") for o in ops], total.replace(".", "")
    changed = sum(a != b for a, b in zip(top, total))
    carry = sum(sum(i < len(c) and c[i] != "0" for c in clean) >= 2 for i in range(max(map(len, clean))))
    return changed + 3 * carry


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.integers(-99999, 99999), st.integers(0, 99)), min_size=3, max_size=3))
def test_addition_difficulty(spark, parts):
    ops = [plain_text(float(f"{a}.{b:02d}")) for a, b in parts]
    total = plain_text(round(sum(map(float, ops)), 2))
    df = spark.createDataFrame([(*ops, total)], "a string, b string, c string, t string")
    assert df.select(D.difficulty_add(["a", "b", "c"], "t").alias("d")).first().d == slow_add(ops, total)


def test_digits_of_reciprocals(spark):
    got = spark.range(1, 9000).select("id", D._share_digits(F.col("id"), 10).alias("ten"), D._share_digits(F.col("id"), 2).alias("two")).collect()
    for r in got:
        text = repr(1 / r.id).split("e")[0]
        assert r.ten == max(1, sum(c in "123456789" for c in text)), r.id
        assert r.two == int((1 / r.id).hex().split("p")[0].replace("0x", "").replace(".", ""), 16).bit_count()
    long = spark.createDataFrame([([str(i) for i in range(100, 165)],)], "l array<string>")
    assert long.select(D.difficulty_mean(F.col("l")).alias("d")).first().d > 65


def test_periods_are_powers():
    assert E.fourier_periods(4, 2) == [0.1, 1.0, 10.0, 100.0, 1000.0, 10000.0]
    assert E.fourier_periods(1, 1, (2, 10)) == [0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 10.0, 16.0, 32.0, 64.0]


def test_decimal_texts():
    import numpy as np

    x, d = np.array([0.0, 12.346, -0.00012345, 99.96, 5e14, 9.996e14, 3e-16, 2.5, 7.0]), np.array([3, 4, 2, 3, 1, 3, 3, 1, 0])
    assert W.round_texts(x, d) == ["0", "12.35", "-0.00012", "100", "500000000000000", "999000000000000", "0", "2", "0"]


def test_other_difficulties(spark):
    df = spark.createDataFrame([(["3.25", "3.2", "-17"],), (["5", "5"],), (["0.001", "0.0015"],)], "l array<string>")
    got = df.select(D.difficulty_sort(F.col("l")).alias("s"), D.difficulty_minmax(F.col("l"), F.col("l")[0]).alias("m"), D.difficulty_mean(F.col("l")).alias("a")).collect()
    # pairs of 03.25, 03.20 share 4 characters, the others none; 4^0.8 = 3.03
    assert (got[0].s, got[0].m) == (4, 4)
    assert (got[1].s, got[1].m) == (1, 0)
    # 0.0010 and 0.0015 share five characters; what is left is 0 and 5 (at least one digit each) plus 1/2
    assert got[2].a == 3
