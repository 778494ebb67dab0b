"""Language-model scores (op12): counts and scores against plain loops."""
import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from tallyforge.llm import context_mixing as cm

BITS = 16


def texts(n=30, seed=4):
    rng = random.Random(seed)
    words = ["the", "theory", "of", "sums", "Über", "naïve", "counts", "x" * 40, "12.5", "\x0c", "über\tall"]
    return [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 40, 200]))) for _ in range(n)]


def plain_contexts(data, i, bits):
    """First slots of the contexts of byte i, from the bytes before it."""
    before = bytes(cm.REACH) + data[:i]
    out = []
    for order in cm.ORDERS:
        seen = int.from_bytes(before[-order:], "big")
        out.append((seen * 2654435761 + order) % 2**32)
    word = 0
    reach = data[max(0, i - i % cm.SEGMENT - cm.REACH) : i]
    tail = reach[max((k + 1 for k, c in enumerate(reach) if cm.SPACE[c]), default=0) :]
    for c in tail:
        word = (word + c + 1) * 0x9E3779B97F4A7C15 % 2**64
    out.append((word >> 32) ^ 0x5BD1E995)
    mixed = []
    for h in out:
        h = (h ^ (h >> 15)) * 0x85EBCA6B % 2**32
        h = (h ^ (h >> 13)) * 0xC2B2AE35 % 2**32
        mixed.append(h >> (32 - bits))
    return mixed


def path(code, c):
    a = code.start[c]
    return [divmod(int(x), 2) for x in code.step[a : a + code.length[c]]]


def plain_score(model, data):
    whole = data + bytes([cm.END])
    ends = set(np.concatenate([cm.block_ends(a, b) for a, b in cm.segments(len(data))]))
    shift, seen, total = np.zeros(cm.PREDICTORS + 1), cm.KEEP, 0.0
    table = model.table * np.minimum(1, 60 / model.table[1])
    pull, hits, n = np.zeros(cm.PREDICTORS + 1), np.zeros((2, cm.ODDS)), 0
    for i, c in enumerate(whole):
        first = plain_contexts(whole, i, model.bits)
        for node, bit in path(model.code, c):
            odds = np.array([float(model.odds[k][f + node]) for k, f in enumerate(first)] + [1.0])
            gate = int((odds[-4:-1] != 0).sum())
            mix = float(np.clip(odds @ (model.weights[:, gate] + shift), -12, 12))
            p = 1 / (1 + math.exp(-mix))
            spot = int(min(max(mix, -8), 8) * 2 + cm.ODDS // 2 + 0.5)
            refined = (p + table[0][spot] / table[1][spot]) / 2
            total += math.log10(refined if bit else 1 - refined)
            pull += odds * (bit - p)
            hits[:, spot] += bit, 1
            n += 1
        if i + 1 in ends:
            seen += n
            shift += pull / (cm.PREDICTORS / 2 * model.curve * seen)
            table = table + hits
            pull, hits, n = pull * 0, hits * 0, 0
    return total


@pytest.fixture(scope="module")
def model(spark):
    rows = [cm.as_bytes(t) for t in texts()]
    chars = sum((np.bincount(np.frombuffer(d, np.uint8), minlength=256) for d in rows), np.zeros(256, np.int64))
    code = cm.huffman(chars)
    df = spark.createDataFrame([(t,) for t in texts()], "text string").repartition(4)
    size = 2 * cm.slots(BITS)
    flat = np.zeros(-(-cm.PREDICTORS * size // cm.CHUNK) * cm.CHUNK, np.float32)
    for r in cm.slot_counts(df, code, BITS).collect():
        flat[r["chunk"] * cm.CHUNK + np.frombuffer(r["at"], np.uint16).astype(int)] = np.frombuffer(r["n"], np.uint64)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(cm, "FAN_IN", 2)
        again = {r["chunk"]: (bytes(r["at"]), bytes(r["n"])) for r in cm.slot_counts(df, code, BITS).collect()}
    assert again == {r["chunk"]: (bytes(r["at"]), bytes(r["n"])) for r in cm.slot_counts(df, code, BITS).collect()}
    counts = flat[: cm.PREDICTORS * size].reshape(cm.PREDICTORS, size)
    want = [Counter() for _ in range(cm.PREDICTORS)]
    for data in rows:
        for i, c in enumerate(data + bytes([cm.END])):
            for k, first in enumerate(plain_contexts(data + bytes([cm.END]), i, BITS)):
                want[k].update(2 * (first + node) + bit for node, bit in path(code, c))
    for k in range(cm.PREDICTORS):
        assert {i: int(counts[k][i]) for i in np.flatnonzero(counts[k])} == want[k]
    return cm.fitted(code, BITS, counts, rows)


def test_codes_are_a_tree():
    code = cm.huffman(np.arange(256) ** 3)
    assert abs(sum(2.0 ** -int(n) for n in code.length) - 1) < 1e-12 and code.length[255] < code.length[0]
    paths = {tuple(path(code, c)) for c in range(256)}
    assert len(paths) == 256 and {n for p in paths for n, _ in p} == set(range(255))


def test_scores_equal_a_plain_loop(model, monkeypatch):
    monkeypatch.setattr(cm, "SEGMENT", 1800)
    rows = [cm.as_bytes(t) for t in [*texts(10, seed=9), "", "a", "The the theory of sums " * 200, "漢字🙂\x00\x00 z" * 30]]
    together = cm.text_scores(model, rows)
    assert together == pytest.approx([plain_score(model, d) for d in rows], rel=1e-4)
    assert together == pytest.approx([cm.text_scores(model, [d])[0] for d in rows], rel=1e-9)
    assert sorted(i for g in cm.groups(rows, 3000) for i in g) == list(range(len(rows)))


def test_training_makes_texts_likelier(model):
    even = cm.fitted(cm.huffman(np.zeros(256, np.int64)), BITS, np.zeros((cm.PREDICTORS, 2 * cm.slots(BITS))), [])
    rows = [cm.as_bytes(t) for t in texts(40, seed=77)]
    size = sum(len(r) + 1 for r in rows)
    assert -cm.text_scores(even, rows).sum() / size / math.log10(2) == pytest.approx(8, abs=0.5)
    assert -cm.text_scores(model, rows).sum() / size / math.log10(2) < 1.5


def plain_base(rows):
    known, n = Counter(), 0
    crc = lambda i: zlib.crc32(str(i).encode()) % 5
    tokens = lambda t: [*cm.as_bytes(t).split(), "end"]
    for i, t in rows:
        if i is not None and crc(i) != 1:
            known.update(tokens(t))
    n, v = sum(known.values()), len(known)
    out = []
    for i, t in rows:
        own = tokens(t)
        base = sum(math.log10((known[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        out.append((i, i is not None and crc(i) == 1, len(own), sum(known[w] > 0 for w in own), n, round(base, 6)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("common", [4, 1 << 18])
def test_base_equals_plain_counts(spark, docs, odd, monkeypatch, common):
    monkeypatch.setattr(cm, "COMMON", common)
    for df in (docs, odd):
        got = cm.scored(df).toPandas()
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        ids = [None if pd.isna(i) else int(i) for i in got["doc_id"]]
        have = sorted(zip(ids, got["held_out"], got["n_tokens"], got["n_known"], got["train_tokens"], got["base_score"].round(6)), key=repr)
        want = plain_base(rows)
        assert [h[:5] for h in have] == [w[:5] for w in want]
        assert [h[5] for h in have] == pytest.approx([w[5] for w in want], abs=2e-6, rel=1e-9)
        assert (got["score"] < 0).all() and (got["bits_per_byte"] > 0).all()
    bpb = cm.scored(docs).where("held_out").agg({"bits_per_byte": "avg"}).first()[0]
    assert bpb < 4


def test_nothing_to_learn_from(spark, odd, empty):
    assert cm.scored(empty).count() == 0
    rows = spark.createDataFrame([(i, "Some text") for i in range(100)], "doc_id bigint, text string")
    alone = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1]
    got = cm.scored(rows.where(rows.doc_id.isin(alone))).toPandas()
    assert len(got) == len(alone) and set(got["n_known"]) == {0} and set(got["train_tokens"]) == {0} and got["base_score"].abs().max() < 1e-12
    assert got["score"].nunique() == 1


def test_evidence_of_several_texts_leaves_out_each_ones_own_counts(model, monkeypatch):
    """Texts are looked up side by side, also those of several segments; each loses only its own counts."""
    monkeypatch.setattr(cm, "SEGMENT", 700)
    rows = [cm.as_bytes(t) for t in [*texts(8, seed=21), "", "the theory of sums " * 90, "the theory of sums"]]
    counts = np.zeros((cm.PREDICTORS, 2 * cm.slots(BITS)), np.float32)
    seen = []
    for data in rows:
        whole = data + bytes([cm.END])
        own = [[(k, 2 * (f + node) + bit) for k, f in enumerate(plain_contexts(whole, i, BITS))] for i, c in enumerate(whole) for node, bit in path(model.code, c)]
        seen.append(own)
        for choice in own:
            for k, at in choice:
                counts[k][at] += 1
    want = []
    for own in seen:
        mine = Counter(x for choice in own for x in choice)
        for choice in own:
            key = choice[0][1] & 1
            for k, at in choice:
                left = [counts[k][a] - mine[k, a] for a in (at & ~1, at | 1)]
                key = key << 8 | int(cm.log_odds(np.float32([left[0]]), np.float32([left[1]]))[0]) + 128
            want.append(key)
    spare = np.zeros(cm.slots(BITS), np.int64)
    assert cm.own_evidence(model.code, BITS, counts, spare, rows).tolist() == want and not spare.any()
    parts = [cm.own_evidence(model.code, BITS, counts, spare, run) for run in cm._runs(rows, 500)]
    assert np.concatenate(parts).tolist() == want and len(parts) > 2
    tally = cm._tally(parts)
    assert dict(zip(tally["key"], tally["n"])) == Counter(want)


def test_a_tally_holds_its_keys_once_beside_the_sorted_ones():
    import tracemalloc

    tracemalloc.start()
    try:
        parts = [np.arange(200_000, dtype=np.uint32) // 5000 for _ in range(10)]
        size = sum(p.nbytes for p in parts)
        tally = cm._tally(parts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert parts == [] and peak < 2.6 * size
    assert tally["key"].tolist() == list(range(40)) and set(tally["n"]) == {50_000}


@pytest.mark.parametrize("query", ["op4_suffix_array", "op12_context_mixing"])
def test_queries_hand_python_few_texts_at_once(spark, tmp_path, query):
    from tallyforge.llm import queries

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.createDataFrame(list(enumerate(texts(20))), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    try:
        spark.conf.set(name, "10000")
        assert queries.QUERIES[query](spark, str(tmp_path)).count() == 20
        assert int(spark.conf.get(name)) <= 1000
    finally:
        spark.conf.set(name, before)


def test_weights_are_fitted_on_all_training_documents(spark, monkeypatch):
    """More and longer documents than any sample: a fit over tasks is that of one process over all of them."""
    monkeypatch.setattr(cm, "PAIRS", 5000)
    rows = [t + " x" * (5000 if i == 7 else 0) for i, t in enumerate(texts(200, seed=12))]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").repartition(5)
    model = cm.trained(df)[0]
    size = 2 * cm.slots(model.bits)
    flat = np.zeros(-(-cm.PREDICTORS * size // cm.CHUNK) * cm.CHUNK, np.float32)
    for r in cm.slot_counts(df, model.code, model.bits).collect():
        flat[r["chunk"] * cm.CHUNK + np.frombuffer(r["at"], np.uint16).astype(int)] = np.frombuffer(r["n"], np.uint64)
    counts = flat[: cm.PREDICTORS * size].reshape(cm.PREDICTORS, size)
    want = cm.fitted(model.code, model.bits, counts, [cm.as_bytes(t) for t in rows])
    assert np.allclose(model.weights, want.weights, atol=1e-5) and np.allclose(model.table, want.table, rtol=1e-6)
    assert model.table[1].sum() - 20 * cm.ODDS == sum(int(model.code.length[c]) for t in rows for c in [*cm.as_bytes(t), cm.END])
