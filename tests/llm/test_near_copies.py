"""Near copies against all pairs, on texts of one template and on copies that differ in one block."""
import random

import numpy as np
import pytest

from tallyforge.llm import near_copies, simhash
from tallyforge.llm.shared import stored

VOCABULARY = [f"w{i}" for i in range(20_000)]


def alike(x, y, similarity=0.8):
    both = len(x & y)
    return both > 0 and both >= similarity * (len(x) + len(y) - both)


def linked(sets):
    return {(i, j) for i in range(len(sets)) for j in range(i) if alike(sets[i], sets[j])}


def missed(spark, texts):
    """Near-copy pairs by comparison of all pairs, those that got different components, and groups that hold no such pair."""
    got = {r.doc_id: r.component for r in near_copies.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    pairs = linked([set(simhash.shingles(t, 5)) for t in texts])
    root = list(range(len(texts)))
    for i, j in pairs:
        old, new = root[i], root[j]
        root = [new if r == old else r for r in root]
    wrong = len(set(root)) - len(set(got.values()))
    return len(pairs), sum(got[i] != got[j] for i, j in pairs), wrong


def changed(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = rng.choice(VOCABULARY)
    return words


def test_texts_of_one_template(spark):
    """Many candidates that are no near copies join all texts; the pairs among them are found all the same."""
    rng = random.Random(11)
    template = [rng.choice(VOCABULARY) for _ in range(300)]
    texts = []
    for _ in range(150):
        base = changed(rng, template, 7)
        texts += [" ".join(base), " ".join(changed(rng, base, 5))]
    rng.shuffle(texts)
    pairs, lost, wrong = missed(spark, texts)
    assert pairs >= 140 and lost == 0 and wrong == 0


@pytest.mark.parametrize("slices", [1, 5])
def test_components_larger_than_a_slice(spark, monkeypatch, slices):
    rng = random.Random(12)
    base = [rng.choice(VOCABULARY) for _ in range(100)]
    texts = [" ".join(changed(rng, base, rng.randrange(0, 12))) for _ in range(60)]
    monkeypatch.setattr(near_copies, "SLICE", 60 // slices)
    pairs, lost, wrong = missed(spark, texts)
    assert pairs and lost == 0 and wrong == 0


def test_copies_that_differ_in_one_block(spark):
    """Pairs are found wherever the edits lie: a passage appended, a block cut out, words changed here and there."""
    rng = random.Random(14)
    texts = []
    for k in range(240):
        base = [rng.choice(VOCABULARY) for _ in range(rng.choice([50, 200, 800]))]
        n, at = int(len(base) * rng.uniform(0.08, 0.16)), rng.randrange(len(base) * 3 // 4)
        more = [rng.choice(VOCABULARY) for _ in range(n)]
        copy = [base + more, base[:at] + base[at + n :], changed(rng, base, len(base) // 60)][k % 3]
        texts += [" ".join(base), " ".join(copy)]
    pairs, lost, wrong = missed(spark, texts)
    assert pairs >= 200 and lost == 0 and wrong == 0


def test_keys_of_least_hashes():
    """At the limit nearly all pairs share a key; a set has the same keys in whatever pieces it is read."""
    rng = np.random.default_rng(15)
    depth = near_copies.band_depth(0.8)
    assert (1 - 0.8**depth) ** near_copies.BANDS <= near_copies.MISS
    for n in (9, 90, 2700):
        for _ in range(200):
            x = rng.integers(0, 1 << 64, 10 * n // 9, np.uint64)
            y = np.concatenate([x[:n], rng.integers(0, 1 << 64, len(x) - n, np.uint64)])
            (a, one), (b, other) = near_copies.band_keys(x, depth), near_copies.band_keys(y, depth)
            assert (a == b).any()
            assert near_copies.unlike(one[None], other[None])[0] <= near_copies.most_unlike(0.8, depth)
    assert len(near_copies.band_keys(np.empty(0, np.uint64), depth)[0]) == 0


@pytest.mark.parametrize("spanning", [False, True])
def test_pairs_of_a_bucket(spanning):
    """All pairs of a bucket within the limit, or as many as join the same rows; labelled rows of one label are not paired."""
    rng = np.random.default_rng(13)
    for n in (1, 2, 40, 300):
        base = rng.integers(0, 1 << 63, (4, 5), np.uint64)
        sketch = base[rng.integers(0, 4, n)] ^ (rng.integers(0, 1 << 63, (n, 5), np.uint64) & rng.integers(0, 1 << 63, (n, 5), np.uint64) & rng.integers(0, 1 << 63, (n, 5), np.uint64))
        keys, label = np.sort(rng.integers(0, 3, n)), np.arange(n) if spanning else rng.integers(0, n // 2 + 1, n)
        most = 55
        want = {
            (i, j) for j in range(n) for i in range(j)
            if keys[i] == keys[j] and label[i] != label[j] and near_copies.unlike(sketch[i : i + 1], sketch[j : j + 1])[0] <= most}
        got = [(int(i), int(j)) for a, b in near_copies.bucket_pairs(keys, sketch, label, most, spanning) for i, j in zip(a, b)]
        assert len(set(got)) == len(got) and set(got) <= want
        if not spanning:
            assert set(got) == want
        root = list(range(n))
        for i, j in got:
            root = [root[j] if r == root[i] else r for r in root]
        assert all(root[i] == root[j] for i, j in want)
        assert not spanning or len(got) == n - len(set(root))


def test_a_template_costs_few_comparisons(spark):
    """Texts of one template far below the limit share keys by the thousand; next to none of those pairs is checked on its texts."""
    rng = random.Random(16)
    template = [rng.choice(VOCABULARY) for _ in range(280)]
    texts = [" ".join(changed(rng, template, 18)) for _ in range(1200)]
    texts += [texts[0] + " one more word", " ".join(texts[1].split()[12:])]
    df = spark.createDataFrame([(i, t, i, 0) for i, t in enumerate(texts)], "id bigint, text string, doc_id bigint, tk int")
    nodes = stored(near_copies._sketches(df, 5, 0.8), "nodes")
    buckets = stored(near_copies.shared_keys(nodes), "buckets").withColumn("label", near_copies.F.col("id"))
    most = near_copies.most_unlike(0.8, near_copies.band_depth(0.8))
    share_a_key = buckets.alias("x").join(buckets.alias("y"), "key").where("x.id < y.id").select("x.id", "y.id").distinct().count()
    pairs = near_copies.candidate_pairs(buckets, most, spanning=False).count()
    assert share_a_key > 20_000 and 2 <= pairs < share_a_key / 100
    links = near_copies.similar_links(nodes, df.select("id", "text"), 5, 0.8).collect()
    assert {(r.a, r.b) for r in links} == {(0, 1200), (1, 1201)}


@pytest.mark.parametrize("slices", [3000, 10**6])
def test_a_failing_link_hides_no_other(spark, monkeypatch, slices):
    """Pairs that only look alike are checked first and fail; the pairs behind them are found all the same."""
    rng = random.Random(17)
    monkeypatch.setattr(near_copies, "most_unlike", lambda *_: 160)
    monkeypatch.setattr(near_copies, "SLICE_SHINGLES", slices)
    base = [rng.choice(VOCABULARY) for _ in range(200)]
    texts = [" ".join(changed(rng, base, rng.choice([1, 4, 9, 14]))) for _ in range(60)]
    pairs, lost, wrong = missed(spark, texts)
    assert pairs and lost == 0 and wrong == 0


def test_similar_rows():
    rng = random.Random(13)
    for _ in range(30):
        base = rng.sample(range(10_000), 40)
        sets = [set()] * 2
        for _ in range(25):
            mine = set(rng.sample(base, rng.randrange(25, 41)))
            sets.append(mine | set(rng.sample(range(10_000), rng.randrange(0, 6))))
        label = np.array([rng.randrange(8) for _ in sets]) if rng.random() < 0.5 else np.arange(len(sets)) + 5
        links = near_copies.similar_rows([np.array(sorted(s), np.uint64) for s in sets], label, 0.8)
        want = {(i, j) for i, j in linked(sets) if label[i] != label[j]}
        assert {(max(a, b), min(a, b)) for a, b in links} <= want
        root = label.tolist()
        for i, j in links:
            root = [root[j] if r == root[i] else r for r in root]
        assert all(root[i] == root[j] for i, j in want) and len(links) == len(set(label.tolist())) - len(set(root))
    assert near_copies.similar_rows([], np.array([]), 0.8) == [] == near_copies.similar_rows([np.empty(0, np.uint64)] * 3, np.arange(3), 0.8)
