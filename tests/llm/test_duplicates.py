"""SimHash near-duplicates (op10), suffix-array repeats (op4) and decontamination (op5) against brute force."""
import hashlib
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyforge.llm import components, decontaminate, near_copies, simhash, suffix_dedup
from tallyforge.llm.shared import stored


def plain_fingerprint(text, words):
    import re

    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall("[^\x20\x09-\x0d]+", lower)
    if not found:
        return 0
    hashed = [xxhash.xxh64_intdigest(" ".join(found[i : i + words]).encode(), 42) for i in range(max(1, len(found) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def least_reachable(ids, linked):
    """Least id reachable from each place, over linked(i, j)."""
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(ids)), 2):
        if linked(i, j):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(x, least.get(find(i), x))
    return [least.get(find(i)) for i in range(len(ids))]


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_near_duplicates(which, request):
    df = request.getfixturevalue(which)
    rows = df.select("doc_id", "text").collect()
    prints = [plain_fingerprint(r.text, 4) for r in rows]
    want = least_reachable([r.doc_id for r in rows], lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    got = simhash.near_duplicates(df).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((r.doc_id, f"{p:016x}", w) for r, p, w in zip(rows, prints, want))


def test_near_duplicates_of_nothing(empty):
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("radius", [2, 4, 9])
def test_links_of_dense_fingerprints(spark, radius, monkeypatch):
    monkeypatch.setattr(simhash, "SLICE", 40)  # large buckets meet slice by slice
    rng = random.Random(radius)
    centres = [rng.getrandbits(64) for _ in range(30)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 8))) for c in centres for _ in range(20)} | {0, 2**64 - 1}
    fps = sorted(np.array(list(fps), np.uint64).view(np.int64).tolist())
    nodes = spark.createDataFrame([(f, f) for f in fps], "id bigint, fp bigint")
    bits = np.array(fps).view(np.uint64)
    links = simhash.near_links(nodes, radius).collect()
    assert all(int(np.bitwise_count(np.uint64(r.a % 2**64) ^ np.uint64(r.b % 2**64))) <= radius for r in links)
    want = least_reachable(fps, lambda i, j: int(np.bitwise_count(bits[i] ^ bits[j])) <= radius)
    place = {f: i for i, f in enumerate(fps)}
    linked = {(min(place[r.a], place[r.b]), max(place[r.a], place[r.b])) for r in links}
    assert least_reachable(fps, lambda i, j: (i, j) in linked) == want


def test_thresholds_cover_the_radius_and_are_cheapest():
    rng = random.Random(4)
    for _ in range(30):
        costs = [{-1: 0.0} | {t: rng.random() for t in range(4)} for _ in range(4)]
        total, chosen = simhash.best_thresholds(costs, 5)
        assert sum(t + 1 for t in chosen) == 6
        best = min(
            sum(c[t] for c, t in zip(costs, (i, j, k, m))) for i in costs[0] for j in costs[0] for k in costs[0] for m in costs[0] if i + j + k + m + 4 == 6)
        assert total == pytest.approx(best)


def test_pair_distances():
    counts = np.random.default_rng(0).integers(0, 5, 64)
    values = np.repeat(np.arange(64), counts)
    want = np.bincount(np.bitwise_count(values[:, None] ^ values[None]).ravel(), minlength=7) / len(values) ** 2
    assert simhash._pair_distances(counts) == pytest.approx(want)


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(150)] + [(7, 7), (None, 3), (2, None)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    nodes = sorted({x for e in edges for x in e if None not in e and e[0] != e[1]})
    linked = {frozenset(e) for e in edges}
    want = least_reachable(nodes, lambda i, j: frozenset((nodes[i], nodes[j])) in linked)
    assert got == dict(zip(nodes, want))
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_near_copies(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for k in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([30, 200, 600]))]
        for j in range(rng.choice([1, 1, 2, 5])):
            words = list(base)
            for _ in range(rng.choice([0, 1, len(base) // 60, len(base) // 20])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((1000 - 7 * k - j, " ".join(words)))
    rows += [(5, ""), (6, None), (6, ""), (None, rows[0][1]), (7, "  ")]
    got = near_copies.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    sets = [set(simhash.shingles(t, 5)) for _, t in rows]

    def alike(i, j):
        both = len(sets[i] & sets[j])
        return (rows[i][1] or "") == (rows[j][1] or "") or (both > 0 and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both))

    want = least_reachable([r[0] for r in rows], alike)
    kept = {r.doc_id for r in got if r.keep}
    assert len({r.component for r in got}) == sum(r.keep for r in got)
    assert kept <= {r[0] for r in rows} and set(want) <= kept  # the least of each group stays
    assert len(kept - set(want)) <= 2  # fingerprints may miss a pair near the limit


def plain_repeats(rows, length):
    seen = Counter()
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        seen.update(b[j : j + length] for j in range(len(b) - length + 1))
    out = Counter()
    for i, b in data:
        covered = np.zeros(len(b), bool)
        for j in range(len(b) - length + 1):
            if seen[b[j : j + length]] > 1:
                covered[j : j + length] = True
        runs = int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum())
        left = bytes(np.frombuffer(b, np.uint8)[~covered])
        out[i, len(b), int(covered.sum()), runs, hashlib.sha256(left).hexdigest()] += 1
    return out


def repeat_rows():
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(700)) for _ in range(6)]
    rows = [
        (1, None), (2, ""), (3, "x" * 1000), (4, "xy" * 300), (5, "é" * 400), (6, base[0]), (7, base[0]), (7, base[0][:350]), (None, base[1]), (None, base[1] + "z"),
        (8, "short"), (8, "short")]
    for k in range(9, 90):
        text = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(len(text))] = rng.choice("XYZ\0é")
        rows.append((k, "".join(text)[rng.randrange(300) :] + rng.choice(base)[rng.randrange(400) :] + "x" * rng.randint(0, 230)))
    line = "the very common line that stands in all of them 0123456789 0123456789 abc"
    for k in range(200, 240):
        rows.append((k, "".join(rng.choice("abcdefgh ") for _ in range(150)) + line + "".join(rng.choice("abcdefgh ") for _ in range(150))))
    return rows


@pytest.mark.parametrize("frequent, bucket, length", [(1024, 20_000, 200), (1, 7, 200), (3, 50, 33), (1024, 9, 2)])
def test_repeats(spark, monkeypatch, frequent, bucket, length):
    monkeypatch.setattr(suffix_dedup, "FREQUENT", frequent)
    monkeypatch.setattr(suffix_dedup, "BUCKET", bucket)
    rows = repeat_rows()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = suffix_dedup.digests(df, length).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == plain_repeats(rows, length)


@pytest.mark.parametrize("decoded", [False, True])
def test_texts_without_repeats_stay_out_of_python(spark, decoded):
    """They are joined to the cleaned ones after the cleaning, as they were; before, each task needed a second worker for them."""
    rows = [(0, "é" * 150 + "a"), (1, "b" + "é" * 150), (2, "short"), (3, ""), (4, None)]
    got = suffix_dedup.cleaned(spark.createDataFrame(rows, "doc_id bigint, text string"), 200, decoded=decoded)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Union") < plan.index("clean(")
    ran = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in ran and "BroadcastHashJoin" not in ran
    found = {r["row"]["doc_id"]: (r["kept"] if decoded else bytes(r["kept"]).decode(), r["n_bytes"], [tuple(s) for s in r["spans"]]) for r in got.collect()}
    assert found == {0: ("a", 301, [(0, 300)]), 1: ("b", 301, [(1, 301)]), 2: ("short", 5, []), 3: ("", 0, []), 4: ("", 0, [])}


def test_repeats_of_odd_rows(odd, empty):
    rows = [(r.doc_id, r.text if r.doc_id not in (6, 7) else None) for r in odd.select("doc_id", "text").collect()]
    small = odd.withColumn("text", F.expr("if(doc_id in (6, 7), null, text)"))
    got = suffix_dedup.digests(small).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == plain_repeats(rows, 200)
    whole = {r.doc_id: r for r in suffix_dedup.digests(odd).where("doc_id in (6, 7)").collect()}
    assert whole[6].n_removed == whole[6].n_bytes and whole[7].n_removed == whole[7].n_bytes - 3
    assert suffix_dedup.digests(empty).count() == 0
    assert suffix_dedup.cleaned(odd, decoded=True).select("row.*").columns == odd.columns


def test_texts_without_repeats_are_not_shuffled(spark):
    rng = random.Random(3)
    fresh = ["".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(600)]
    rows = [(None if k == 7 else k, t + fresh[0][:250] * (k % 100 == 7)) for k, t in enumerate(fresh)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    keyed = suffix_dedup._keyed(df, "doc_id", "text")
    some = keyed.where("doc_id is null or doc_id % 100 = 7")
    may = keyed.where(suffix_dedup._may_be_in(some.select("doc_id", "tk"))("doc_id", "tk"))
    assert some.exceptAll(may).count() == 0 and may.count() < 30
    texts, lists = suffix_dedup._with_text(some.withColumn("i", F.lit(4)), keyed, ["i"])
    assert sorted((str(r.doc_id), [x.i for x in r.rows]) for r in texts.collect()) == sorted((str(i), [4]) for i in [None, 107, 207, 307, 407, 507])
    suffix_dedup.discard(lists)
    got = suffix_dedup.digests(df).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == plain_repeats(rows, 200)
    assert "Union" in suffix_dedup.cleaned(df)._jdf.queryExecution().optimizedPlan().toString()


def test_multikey_quicksort():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, (400, 4)).astype(np.uint64)
    order, group = suffix_dedup.multikey_quicksort(words)
    want = sorted(map(tuple, words.tolist()))
    assert [tuple(w) for w in words[order].tolist()] == want
    assert [a == b for a, b in zip(group, group[1:])] == [a == b for a, b in zip(want, want[1:])]


def test_masks_lose_no_overlap():
    window, few = decontaminate.WINDOW, decontaminate.SUBSTITUTIONS
    for changed in combinations(range(window), few):
        assert any(
            not any(at + m in changed for m in mask) for mask in decontaminate.MASKS for at in range(window - mask[-1]))


def plain_overlaps(rows, items):
    out = set()
    for i, text in rows:
        a = decontaminate.words(text)
        for k, item in items:
            b = decontaminate.words(item)
            size = min(decontaminate.WINDOW, len(b))
            if not b:
                continue
            allowed = decontaminate.SUBSTITUTIONS if len(b) >= decontaminate.WINDOW else 0
            if any(sum(x != y for x, y in zip(a[p : p + size], b[q : q + size])) <= allowed for p in range(len(a) - size + 1) for q in range(len(b) - size + 1)):
                out.add((i, k))
    return out


def test_overlaps(spark, odd, empty):
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 12, 13, 14, 30])))) for k in range(25)] + [(90, None), (91, ""), (None, "n1 n2 n3 n4 n5 n6 n7 n8 n9 n10")]
    rows = [(1, None), (2, ""), (3, "n1 n2 n3 n4 n5 n6 n7 n8 n9 n10 more"), (None, items[3][1])]
    for i in range(10, 120):
        text = [rng.choice(vocabulary) for _ in range(20)] + (rng.choice(items)[1] or "").split() + [rng.choice(vocabulary) for _ in range(10)]
        for _ in range(rng.randrange(4)):
            text[rng.randrange(len(text))] = "Changed"
        rows.append((i, ", ".join(text)))
    df = spark.createDataFrame(rows + rows[-1:], "doc_id bigint, text string")
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.overlaps(df, benchmark).collect()
    assert Counter((r.doc_id, r.item_id) for r in got) == Counter(plain_overlaps(rows, items))
    assert decontaminate.overlaps(empty, benchmark).count() == 0
    assert decontaminate.overlaps(df, benchmark.where("false")).count() == 0
    same = stored(odd.selectExpr("cast(9 as bigint) as item_id", "'has only the id of the others But this one' as text").limit(1), "item")
    assert decontaminate.overlaps(odd, same).count() == 0
