"""Benchmark passages in documents, found by spaced seeds and verified along the diagonal.

A seed reads some of the words in a row and ignores the others, as its mask says; two texts that differ in an ignored word
still share it. The masks used here miss no overlap of WINDOW words with up to SUBSTITUTIONS of them changed (a test tries all
places). Seeds of items and of documents meet in a join on their hash; a fixed-size bit map of the items' seeds, sent to the
tasks, keeps the documents' other seeds out of it. Around every hit the texts are then compared word by word.
"""
from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import lean, stored, text_key

#: Places of the words that a seed reads.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
#: An overlap has this many words in a row, of which so many may differ. Shorter items must stand there whole and unchanged: their
#: seed reads all their words. Items without a word are not looked for.
WINDOW, SUBSTITUTIONS = 13, 2
#: The map has 2 ** MAP_BITS bits whatever the size of the benchmark.
MAP_BITS = 24

_WORD = re.compile(r"\w+")
_HASHES: dict[str, int] = {}


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def word_hashes(found: list[str]) -> np.ndarray:
    import xxhash

    known = _HASHES
    new = set(found).difference(known)
    if len(known) + len(new) > 300_000:
        known.clear()
        new = set(found)
    for w in new:
        known[w] = xxhash.xxh64_intdigest(w.encode())
    return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))


def seeds(hashes: np.ndarray, whole: Sequence[int] = ()) -> Iterator[tuple[int, np.ndarray]]:
    """(mask number, hash of the seed at each place) for all masks and for runs of as many words as `whole` says (numbers below 0)."""
    for number, mask in [*enumerate(MASKS), *((-k, range(k)) for k in whole)]:
        n = len(hashes) - mask[-1]
        if n > 0:
            total = np.full(n, np.array(number + 1).astype(np.uint64), np.uint64)
            for place in mask:
                total = (total ^ hashes[place : place + n]) * np.uint64(0x9E3779B97F4A7C15)
                total ^= total >> np.uint64(29)
            yield number, total


def _seed_rows(items: DataFrame) -> DataFrame:
    """Seeds of the items by the masks, or of short ones the one of the whole item (mask: 0, or their number of words)."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for item, text in zip(batch["item_id"], batch["text"]):
                hashes = word_hashes(words(text))
                short = len(hashes) if len(hashes) < WINDOW else 0
                for number, seed in seeds(hashes, [short] if short else ()):
                    if (number < 0) == (short > 0):
                        yield pd.DataFrame({"item_id": item, "item_word": np.arange(len(seed), dtype=np.int32), "seed": seed.view(np.int64), "short": short})
        _HASHES.clear()

    return items.mapInPandas(lean(cut), "item_id bigint, item_word int, seed bigint, short int")


def _bit_map(rows: DataFrame) -> np.ndarray:
    """Packed bits of the seeds present: 2 ** MAP_BITS / 8 bytes."""
    slot = F.shiftrightunsigned("seed", 64 - MAP_BITS)
    bits = rows.select(F.shiftright(slot, 3).cast("int").alias("byte"), F.pow(F.lit(2), slot % 8).cast("int").alias("bit"))
    packed = bits.groupBy("byte").agg(F.bit_or("bit").alias("bits"))
    by_page = packed.groupBy(F.shiftright("byte", 12).alias("page")).agg(F.collect_list(F.struct("byte", "bits")).alias("rows"))

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for page, rows in zip(batch["page"], batch["rows"]):
                out = np.zeros(4096, np.uint8)
                for r in rows:
                    out[r["byte"] & 4095] = r["bits"]
                yield pd.DataFrame({"page": [page], "bits": [out.tobytes()]})

    out = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    for page, raw in by_page.mapInPandas(lean(fill), "page int, bits binary").collect():
        out[page * 4096 : (page + 1) * 4096] = np.frombuffer(raw, np.uint8)
    return out


def _document_seeds(docs: DataFrame, bits: np.ndarray, short: Sequence[int]) -> DataFrame:
    """Seeds of the documents that the map lets pass; `short` are the lengths of the short items."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = sent.value
        for batch in batches:
            ids, places, found = [], [], []
            for row, text in enumerate(batch["text"]):
                for _, seed in seeds(word_hashes(words(text)), short):
                    slot = (seed >> np.uint64(64 - MAP_BITS)).astype(np.int64)
                    hit = np.flatnonzero(bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
                    if len(hit):
                        ids.append(np.full(len(hit), row))
                        places.append(hit)
                        found.append(seed[hit])
            if ids:
                row = batch.iloc[np.concatenate(ids)]
                yield pd.DataFrame({
                    "doc_id": row["doc_id"].astype("Int64").to_numpy(), "tk": row["tk"].to_numpy(),
                    "doc_word": np.concatenate(places).astype(np.int32), "seed": np.concatenate(found).view(np.int64)})
        _HASHES.clear()  # the worker process may go on with other work

    return docs.mapInPandas(lean(cut), "doc_id bigint, tk int, doc_word int, seed bigint")


def overlap(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int] | None:
    """(first document word, words, equal words) of the overlaps on a diagonal, from the first to the last; None if there is none.

    An overlap is WINDOW words (or the item, if shorter) of which at most SUBSTITUTIONS differ (none if shorter).
    """
    first, last = max(0, diagonal), min(len(doc), len(item) + diagonal)
    size = min(WINDOW, len(item))
    if last - first < size or not size:
        return None
    equal = doc[first:last] == item[first - diagonal : last - diagonal]
    sums = np.concatenate([[0], np.cumsum(equal)])
    allowed = SUBSTITUTIONS if len(item) >= WINDOW else 0
    good = np.flatnonzero(sums[size:] - sums[:-size] >= size - allowed)
    if not len(good):
        return None
    begin, end = int(good[0]), int(good[-1]) + size
    return first + begin, end - begin, int(sums[end] - sums[begin])


def overlaps(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, tk, item_id, first_word, n_words, n_equal) for every document that holds a passage of an item, best passage each.

    Words are runs of letters, digits and underscores, lower-cased. An item of fewer than WINDOW words must stand in a document whole
    and unchanged. Null texts have no words, and items without a word are in no document; null ids are matched and returned like
    others; rows that repeat are reported once. `tk` is a hash of the text, for rows that share an id.
    """
    keyed = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).withColumn("tk", text_key())
    benchmark = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).alias("text"))
    test = stored(_seed_rows(benchmark), "item-seeds")
    short = sorted(r["short"] for r in test.where("short > 0").select("short").distinct().collect())
    train = _document_seeds(keyed, _bit_map(test), short)
    hits = train.join(test.drop("short"), "seed").select("doc_id", "tk", "item_id", (F.col("doc_word") - F.col("item_word")).alias("diagonal"))
    # as many diagonals at most as the document and the item have words
    pairs = stored(hits.groupBy("doc_id", "tk", "item_id").agg(F.collect_set("diagonal").alias("diagonals")), "hits")
    pairs = pairs.select(F.col("doc_id").alias("_id"), F.col("tk").alias("_tk"), F.col("item_id").alias("_item"), "diagonals")
    with_items = pairs.join(benchmark.select("item_id", F.col("text").alias("item")).distinct(), F.col("_item").eqNullSafe(F.col("item_id")))
    texts = keyed.join(with_items, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tk") == F.col("_tk")))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, tk, text, item_key, item, diagonals in batch[["doc_id", "tk", "text", "item_id", "item", "diagonals"]].itertuples(index=False):
                a, b = word_hashes(words(text)), word_hashes(words(item))
                found = [o for d in sorted(diagonals) if (o := overlap(a, b, int(d)))]
                if found:
                    best = max(found, key=lambda o: (o[2], -o[0]))
                    out.append((doc, tk, item_key, *best))
            frame = pd.DataFrame(out, columns=["doc_id", "tk", "item_id", "first_word", "n_words", "n_equal"])
            yield frame.astype({"doc_id": "Int64", "item_id": "Int64"})
        _HASHES.clear()

    columns = texts.select("doc_id", "tk", "text", "item_id", "item", "diagonals")
    return columns.mapInPandas(lean(verify), "doc_id bigint, tk int, item_id bigint, first_word int, n_words int, n_equal int").distinct()
