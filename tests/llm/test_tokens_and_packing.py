"""Token cache, Arrow token files (op3), packing (op6) and edit-aware counts (op9)."""
import random
import zlib
from itertools import combinations_with_replacement

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import packing, token_counts, token_files
from tallyforge.llm.queries import drawn_edits
from tallyforge.llm.shared import scratch, stored
from tallyforge.llm.tokens import TokenCache

BYTES, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
PARTS = list("ab '.,!1\n\té½²ſⅷ sreldX_|") + ["'re", "'ll", " \n ", "  ", "é", "　", "漢字", "\x1c", "\x85", "\xa0", "<|endoftext|>", "İŞ", "The ", "word "]


def drawn(rng, n):
    return "".join(rng.choice(PARTS) for _ in range(n))


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_cache_gives_the_librarys_ids(path, docs):
    rng = random.Random(1)
    texts = [drawn(rng, rng.randrange(60)) for _ in range(1500)] + [r[0] for r in docs.select("text").collect()] + [None, ""]
    for pieces in (1_000_000, 300):  # the small memory forgets again and again
        cache = TokenCache(path, pieces)
        for text, ids in zip(texts, cache.ids(texts)):
            assert ids.tolist() == cache.whole(text or "").tolist(), repr(text)


def test_token_files_round_trip(spark, odd):
    folder = scratch(spark, "test-tokens")
    token_files.write_tokens(odd, folder, WORDS, end_id=1)
    got = sorted(token_files.read_documents(spark, folder).collect(), key=lambda r: r.start)
    cache, at = TokenCache(WORDS), 0
    rows = sorted(odd.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id, r.text is not None, (r.text or "").encode()))
    for want, r in zip(rows, got, strict=True):
        ids = [*cache.whole(want.text or "").tolist(), 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (want.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_token_file_random_access(spark, odd):
    folder = scratch(spark, "test-access")
    shards = token_files.write_tokens(odd, folder, WORDS).collect()
    for s in shards:
        file = token_files.TokenFile(folder, s.shard)
        assert sum(len(b) for b in file.batches) == s.n_sequences
        assert all(len(b) == token_files.ROWS for b in file.batches[:-1])
        masks = [file.sequence(i)[1].to_numpy(zero_copy_only=False) for i in range(s.n_sequences)]
        assert sum(m.sum() for m in masks) == s.n_tokens and all(m.all() for m in masks[:-1])
        flat = np.concatenate([file.sequence(i)[0] for i in range(s.n_sequences)])
        assert flat[: s.n_tokens].tolist() == file.run(0, s.n_tokens).tolist()
        ids, _ = file.sequence(0)
        assert ids.base is not None and isinstance(file.source, pa.MemoryMappedFile)  # a view of the mapped file


def test_token_files_of_nothing(spark, empty):
    folder = scratch(spark, "test-empty")
    assert token_files.write_tokens(empty, folder, WORDS).count() == 0
    assert token_files.read_documents(spark, folder).count() == 0


@pytest.mark.parametrize("n, want", [(0, []), (5, [(0, 5)]), (8, [(0, 8)]), (9, [(0, 1), (1, 8)]), (20, [(0, 4), (4, 8), (12, 8)])])
def test_cut_points(n, want):
    assert packing.cut_points(n, 8) == want


def test_slack_plan_fills_as_full_as_any_choice():
    rng = random.Random(2)
    for _ in range(200):
        context = rng.randrange(5, 20)
        counts = {n: rng.randrange(0, 4) for n in rng.sample(range(1, context + 1), 4)}
        left = dict(counts)
        for times, used in packing.slack_plan(counts, context):
            longest = max(n for n, c in left.items() if c)
            fill = sum(n * k for n, k in used)
            assert dict(used).get(longest) and fill <= context
            items = [n for n, c in left.items() for _ in range(c)]
            best = max(
                sum(c) + longest for r in range(len(items)) for c in combinations_with_replacement(sorted(set(items)), r)
                if sum(c) + longest <= context and all((*c, longest).count(n) <= left[n] for n in set(c) | {longest}))
            assert fill == best
            for n, k in used:
                left[n] -= times * k
                assert left[n] >= 0
        assert not any(left.values())


def check_packing(rows, context):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= context
    return len(by)


def test_pack_all_pieces(spark, odd):
    pieces = stored(packing.token_pieces(odd, BYTES, 2, context=64), "test-pieces")
    rows = packing.pack(pieces, 64).collect()
    assert len(rows) == pieces.count()
    n = check_packing(rows, 64)
    assert n <= sum(r.length for r in rows) / 64 * 1.05 + 2
    cache = TokenCache(BYTES)
    want = sorted([*cache.whole(r.text or "").tolist(), 2] for r in odd.select("text").collect())
    docs = {}
    for r in rows:
        docs.setdefault((r.doc_id, r.start), []).append(r)
    assert sum(len(w) for w in want) == sum(r.length for r in rows)
    joined = packing.sequences(packing.pack(pieces, 64)).collect()
    assert len(joined) == n and all(len(r.ids) == 4 * r.length for r in joined)
    ids = {r.sequence_id: np.frombuffer(r.ids, "<u4") for r in joined}
    again = packing.pack(pieces, 64).collect()
    assert all(np.frombuffer(r.ids, "<u4").tolist() == ids[r.sequence_id][r.offset : r.offset + r.length].tolist() for r in again)


def test_pieces_do_not_depend_on_how_many_words_are_remembered(spark):
    df = spark.createDataFrame([(k, " ".join(f"w{(k * j) % 997}" for j in range(300))) for k in range(300)], "doc_id bigint, text string")
    few, many = (packing.token_pieces(df, BYTES, 2, remembered=n) for n in (50, 800_000))
    key = lambda rows: sorted((r["doc_id"], r["piece"], r["start"], bytes(r["ids"])) for r in rows.collect())
    assert key(few) == key(many)


def test_pack_nothing_and_odd_lengths(spark, empty):
    pieces = stored(packing.token_pieces(empty, BYTES, 2), "test-none")
    assert packing.pack(pieces).count() == 0
    rows = spark.createDataFrame([(1, 3), (2, None), (3, 0), (4, 5), (4, 5)], "k int, length bigint")
    got = {(r.k, r.length, r.sequence_id is None) for r in packing.pack(rows, 8).collect()}
    assert got == {(1, 3, False), (2, None, True), (3, 0, True), (4, 5, False)}
    with pytest.raises(ValueError, match="lengths"):
        packing.pack(rows, 4)


def test_edited_trees_count_like_a_full_encoding():
    rng, cache = random.Random(3), TokenCache(BYTES)
    for _ in range(60):
        doc = token_counts.Counted.build(drawn(rng, rng.randrange(400)), cache, P.PATTERN)
        for _ in range(10):
            start, length, insert = rng.randrange(len(doc.text) + 3), rng.choice([0, 0, 1, 3, 40, 500]), drawn(rng, rng.choice([0, 1, 3, 30, 300]))
            want = doc.text[:start] + insert + doc.text[start + length :]
            doc.edit(start, length, insert, cache, P.PATTERN)
            assert doc.text == want and doc.n_tokens == len(cache.whole(want)) and doc.chars[1] == len(want)
            half = len(doc.chars) // 2
            for t in (doc.chars, doc.tokens):
                assert all(t[i] == t[2 * i] + t[2 * i + 1] for i in range(1, half))


def test_an_edit_reads_a_small_part():
    cache = TokenCache(BYTES)
    doc = token_counts.Counted.build("some words and more of them, " * 5000, cache, P.PATTERN)
    doc.edit(70_000, 5, "other", cache, P.PATTERN)
    assert doc.read <= 3 * token_counts.LEAF


def test_apply_edits(spark, odd):
    trees = odd.withColumn("tree", token_counts.tree(BYTES, P.PATTERN))
    edits = drawn_edits(odd.select("doc_id", "text"))
    rows = token_counts.apply_edits(trees, edits.unionByName(edits.limit(2)), BYTES, P.PATTERN)
    got = rows.select("doc_id", "text", token_counts.n_tokens().alias("n"), "n_edits").collect()
    assert len(got) == odd.count()
    cache = TokenCache(BYTES)
    assert all(r.n == len(cache.whole(r.text)) for r in got)
    strange = spark.createDataFrame([(4, 1, None, -3, "ab"), (4, 2, 99, 5, None), (77, 1, 0, 1, "z")], "doc_id bigint, seq bigint, start bigint, length bigint, insert string")
    got = {(r.doc_id, r.text) for r in token_counts.apply_edits(trees, strange, BYTES, P.PATTERN).where("doc_id in (4, 77)").collect()}
    assert got == {(4, "abRe.")}
    assert token_counts.apply_edits(trees.where(F.lit(False)), edits, BYTES, P.PATTERN).count() == 0
