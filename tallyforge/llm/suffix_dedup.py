"""Exact repeats of byte strings, by suffix arrays in range-partitioned buckets.

A byte is removed if a string of `length` bytes that covers it also starts elsewhere. Only suffixes that can repeat are
sorted. Each window of `length` bytes belongs to its anchor, the place of the least hash among its shorter grams, so equal
windows have equal anchors at equal distances:

1. Anchors whose gram occurs once have no repeated window. Grams are counted alone, and a bit map of those that recur (its size
   is bounded) keeps most other stretches out of all that follows. Stretches (all windows of an anchor) that recur repeat whole.
2. What is left are stretches at the borders of repeats. Sampled splitters deal out the suffixes at their anchors by their
   leading bytes, the gram, so that equal grams meet. Each bucket sorts them by multikey quicksort, and their left contexts,
   read backwards, in the same way; two windows are equal if they lie in one run of both orders, by the lengths of the common
   prefixes of neighbours.
3. A gram in very many different stretches (a common line) would make a large bucket. Those stretches are cut into blocks of
   windows, judged like stretches, and the windows still open are suffixes of their own: splitters may fall among equal ones,
   each bucket compares neighbours after its sort, and the ends of buckets are compared with each other.

Texts are joined with what was found in them three times. Bit maps of the documents concerned keep the others out of these joins.

Hashes of 64 bits stand for strings only beside the hash of a gram they contain, 128 bits together.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import bit_map, discard, in_map, lean, partitions, stored, text_key

#: Windows of a block in step 3, and the number of different stretches of one gram from which on step 3 takes them.
BLOCK, FREQUENT = 8, 1024
#: Rows of a bucket in step 2.
BUCKET = 20_000
#: Bytes of text that a task hashes at once, unless one document is longer, and stretches that it hands back at once.
AT_ONCE, HANDED = 1 << 16, 1 << 14
#: The map of recurring grams has 16 bits for each, and so many at most: beyond that it lets more pass, and results stay the same.
MAP_BITS = 27
#: A pair of hashes with more than this share of all rows is met by a broadcast; there are fewer than this many.
HOT = 4096
_GRAM, _CHUNK = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2 ** 64, for exponents up to n."""
    if base not in _POWERS or len(_POWERS[base][0]) <= n:
        rows = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(max(n, AT_ONCE) + 1, b, np.uint64)
            p[0] = 1
            rows.append(np.multiply.accumulate(p))
        _POWERS[base] = tuple(rows)
    return _POWERS[base]


def _prefix(data: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(base, len(data))[0][: len(data)], out=out[1:])
    return out


def _hashes(prefix: np.ndarray, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for each pair, the same wherever the bytes stand."""
    h = (prefix[end] - prefix[start]) * _powers(base, len(prefix))[1][start]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of keys[i : i + width] for every i with a whole window, from running minima inside blocks of `width`."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(ahead[:n], behind[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, first window, windows, anchor, gram hash, stretch hash) of each stretch of windows with one anchor.

    `data` holds the documents one after another, `ends` where each one ends; places count from the start of `data`.
    """
    if len(data) < length:
        return tuple(np.empty(0, np.int64) for _ in range(4)) + tuple(np.empty(0, np.uint64) for _ in range(2))
    place = np.arange(len(data) - gram + 1, dtype=np.int64)
    grams = _hashes(_prefix(data, _GRAM), _GRAM, place, place + gram)
    least = _sliding_least((grams & np.uint64(0xFFFFFFFF00000000)) | place.astype(np.uint64), length - gram + 1)
    first = place[: len(least)]
    document = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[: len(first)]
    inside = first + length <= ends[document]
    first, document, anchor = first[inside], document[inside], (least[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if not len(first):
        return anchors(data[:0], ends, length, gram)
    # a window that crosses documents lies between, so a new document always begins a new stretch
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (first[1:] != first[:-1] + 1)]))
    last = np.append(new[1:], len(first)) - 1
    stretch = _hashes(_prefix(data, _CHUNK), _CHUNK, first[new], first[last] + length)
    return document[new], first[new], last - new + 1, anchor[new], grams[anchor[new]], stretch


def _batches(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about AT_ONCE bytes."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > AT_ONCE:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Documents by id and text; `tk` tells apart rows that share an id."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.withColumn("tk", text_key())


def _gram_counts(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(kh, n): anchors' grams and how many stretches have them, counted within a task's batches."""
    def counted(found: list[np.ndarray]) -> pd.DataFrame:
        kh, n = np.unique(np.concatenate(found), return_counts=True)
        return pd.DataFrame({"kh": kh.view(np.int64), "n": n})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, found = [(t or "").encode() for t in batch["text"]], []
            for begin, end in _batches(texts):
                found.append(anchors(*_joined(texts[begin:end]), length, gram)[4])
                if sum(map(len, found)) > HANDED:
                    yield counted(found)
                    found = []
            if found:
                yield counted(found)

    return rows.mapInPandas(lean(count), "kh bigint, n bigint").groupBy("kh").agg(F.sum("n").alias("n"))


def _stretches(rows: DataFrame, length: int, gram: int, again: np.ndarray) -> DataFrame:
    """Stretches by document: first window `i`, and in `shape` the number of windows (upper half) and the anchor's distance.

    Only those whose gram may be in the map `again`.
    """
    sent = rows.sparkSession.sparkContext.broadcast(again)

    def listed(keys: pd.DataFrame, found: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
        row, i, shape, kh, ch = (np.concatenate(parts) for parts in zip(*found))
        own = keys.iloc[row]
        return pd.DataFrame({
            "doc_id": own["doc_id"].astype("Int64").to_numpy(), "tk": own["tk"].to_numpy(), "i": i.astype(np.int32),
            "shape": shape.astype(np.int32), "kh": kh.view(np.int64), "ch": ch.view(np.int64)})

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, keys, kept = [(t or "").encode() for t in batch["text"]], batch[["doc_id", "tk"]], []
            for begin, end in _batches(texts):
                data, ends = _joined(texts[begin:end])
                found = anchors(data, ends, length, gram)
                keep = in_map(sent.value, found[4])
                document, first, n, anchor, kh, ch = (f[keep] for f in found)
                document = document.astype(np.int64)
                base = np.concatenate([[0], ends[:-1]])[document]
                kept.append((begin + document, first - base, n << 16 | anchor - first, kh, ch))
                if sum(len(k[0]) for k in kept) > HANDED:
                    yield listed(keys, kept)
                    kept = []
            if kept:
                yield listed(keys, kept)

    return rows.mapInPandas(lean(find), "doc_id bigint, tk int, i int, shape int, kh bigint, ch bigint")


def _judged(rows: DataFrame, part: str, whole: str) -> tuple[DataFrame, DataFrame, DataFrame, list[DataFrame]]:
    """Of rows with a hash of what all their windows share (`part`) and of all they cover (`whole`): those whose whole recurs;
    and one of each different whole whose part recurs in another, few of one part and many. All others have no repeated window
    or are like one of these. Last, the table they are read from."""
    cols = [c for c in rows.columns if c not in (part, whole)]
    one = [F.first(c).alias(c) for c in cols]  # all of the same row
    distinct = stored(rows.groupBy(part, whole).agg(F.count(F.lit(1)).alias("times"), *one), "distinct")
    total = distinct.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    again = distinct.where("times > 1").select(F.col(part).alias("_p"), F.col(whole).alias("_w"), (F.col("times") * HOT > total).alias("_hot"))
    same = (F.col(part) == F.col("_p")) & (F.col(whole) == F.col("_w"))
    hot = F.broadcast(again.where("_hot"))
    repeated = rows.join(hot, same, "left_semi").unionByName(rows.join(hot, same, "left_anti").join(again.where("not _hot"), same, "left_semi"))
    kinds = stored(distinct.groupBy(F.col(part).alias("_p")).agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "kinds")
    open_ = distinct.join(kinds, F.col(part) == F.col("_p")).select(part, whole, *cols, "kinds")
    few, many = (open_.where(F.col("kinds") <= FREQUENT), open_.where(F.col("kinds") > FREQUENT))
    return repeated, few.drop("kinds"), many.drop("kinds"), [distinct, kinds]


def _map_bits(n: int) -> int:
    return min(max((16 * n).bit_length(), 15), MAP_BITS)


def _may_be_in(keys: DataFrame) -> Callable[..., Column]:
    """Of id and text key: true for those among the rows of `keys` (`doc_id`, `tk`) and for few others, by a bit map."""
    sent = keys.sparkSession.sparkContext.broadcast(bit_map(keys.select(F.xxhash64("doc_id", "tk").alias("h")), "h", _map_bits(keys.count())))

    @F.pandas_udf("boolean")
    def found(h: pd.Series) -> pd.Series:
        return pd.Series(in_map(sent.value, h.to_numpy(np.int64).view(np.uint64)))

    return lambda doc_id, tk: found(F.xxhash64(doc_id, tk))


def _with_text(rows: DataFrame, keyed: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Documents that have rows, with the list of their rows (a document has no more of them than bytes); and the stored lists.

    Hardly any other text is shuffled. A document that is there twice comes twice. That changes nothing: all its stretches recur,
    so its windows are known to repeat.
    """
    lists = stored(rows.groupBy("doc_id", "tk").agg(F.collect_list(F.struct(*columns)).alias("rows")), "lists")
    texts = keyed.where(_may_be_in(lists.select("doc_id", "tk"))("doc_id", "tk"))
    own = lists.select(F.col("doc_id").alias("_id"), F.col("tk").alias("_tk"), "rows")
    # a merge join, also of small tables: else what follows would need a second Python worker in each task beside that of the map
    one_each = texts.join(own.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tk") == F.col("_tk")))
    return one_each.select("doc_id", "tk", "text", "rows"), lists


def _blocks(data: np.ndarray, rows: list, length: int) -> tuple[np.ndarray, ...]:
    """(first window, windows, hash of what they share, hash of what they cover) of blocks of BLOCK windows, on a grid from the anchor."""
    i, shape, kh = (np.array([r[c] for r in rows], np.int64) for c in ("i", "shape", "kh"))
    n, p = shape >> 16, i + (shape & 0xFFFF)
    low, high = (p - i - n + 1) // BLOCK, (p - i) // BLOCK
    many = high - low + 1
    row = np.repeat(np.arange(len(i)), many)
    grid = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + low[row]
    first = np.maximum(p[row] - grid * BLOCK - BLOCK + 1, i[row])
    last = np.minimum(p[row] - grid * BLOCK, i[row] + n[row] - 1)
    prefix = _prefix(data, _CHUNK)
    core = _hashes(prefix, _CHUNK, p[row] - grid * BLOCK, p[row] - grid * BLOCK - BLOCK + 1 + length)
    whole = _hashes(prefix, _CHUNK, first, last + length)
    return first, last - first + 1, core.view(np.int64) ^ kh[row], whole.view(np.int64)


def _pieces(texts: DataFrame, length: int) -> DataFrame:
    """Of the listed stretches the bytes, or for those of a frequent gram their blocks (then bytes is null)."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, tk, text, rows in zip(batch["doc_id"].astype("Int64"), batch["tk"], batch["text"], batch["rows"]):
                data = text.encode()
                few, many = [r for r in rows if not r["frequent"]], [r for r in rows if r["frequent"]]
                if few:
                    i, shape = (np.array([r[c] for r in few], np.int32) for c in ("i", "shape"))
                    none = np.zeros(len(i), np.int64)
                    yield pd.DataFrame({
                        "doc_id": pd.array([doc_id] * len(i), "Int64"), "tk": np.full(len(i), tk, np.int32), "i": i, "n": shape >> 16, "anchor": shape & 0xFFFF,
                        "kh": none, "ch": none, "bytes": [data[a : a + b - 1 + length] for a, b in zip(i.tolist(), (shape >> 16).tolist())]})
                if many:
                    first, n, core, whole = _blocks(np.frombuffer(data, np.uint8), many, length)
                    yield pd.DataFrame({
                        "doc_id": pd.array([doc_id] * len(n), "Int64"), "tk": np.full(len(n), tk, np.int32), "i": first.astype(np.int32), "n": n.astype(np.int32),
                        "anchor": np.zeros(len(n), np.int32), "kh": core, "ch": whole, "bytes": None})

    return texts.mapInPandas(lean(cut), "doc_id bigint, tk int, i int, n int, anchor int, kh bigint, ch bigint, bytes binary")


def _suffixes(texts: DataFrame, length: int) -> DataFrame:
    """The leading `length` bytes of each suffix of the listed blocks."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, tk, text, rows in zip(batch["doc_id"].astype("Int64"), batch["tk"], batch["text"], batch["rows"]):
                data = text.encode()
                places = sorted({i for r in rows for i in range(r["i"], r["i"] + r["n"])})
                for at in range(0, len(places), 10_000):
                    part = places[at : at + 10_000]
                    yield pd.DataFrame({
                        "doc_id": pd.array([doc_id] * len(part), "Int64"), "tk": np.full(len(part), tk, np.int32), "i": np.array(part, np.int32),
                        "suffix": [data[i : i + length] for i in part]})

    return texts.mapInPandas(lean(cut), "doc_id bigint, tk int, i int, suffix binary")


def multikey_quicksort(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): rows of `words` in ascending order, and a number that only equal rows share, along that order.

    Three-way quicksort by one word (eight bytes) after another: every round splits each open segment at the word of its
    middle row into less, equal and more; the equal ones go on with the next word. All segments of a round are split at once.
    """
    n, depth_end = words.shape
    order, segment, depth = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    while True:
        starts = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]])) if n else np.empty(0, np.int64)
        sizes = np.diff(np.append(starts, n))
        open_ = np.repeat((sizes > 1) & (depth[starts] < depth_end), sizes) if n else np.empty(0, bool)
        at = np.flatnonzero(open_)
        if not len(at):
            return order, segment
        middle = np.repeat(starts + sizes // 2, sizes)[at]
        mine, pivot = words[order[at], depth[at]], words[order[middle], depth[at]]
        side = np.where(mine < pivot, 0, np.where(mine == pivot, 1, 2))
        part = segment[at] * 3 + side
        moved = np.argsort(part, kind="stable")
        order[at] = order[at][moved]
        depth[at] = (depth[at] + (side == 1))[moved]
        full = segment * 3
        full[at] = part[moved]
        segment = np.concatenate([[0], np.cumsum(full[1:] != full[:-1])]) if n else segment


def _neighbours(words: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the order of rows, and how many leading bytes each row in it shares with the one before."""
    order, _ = multikey_quicksort(words)
    common = np.zeros(len(order), np.int64)
    for a in range(1, len(order), 4096):
        rows = order[a - 1 : a + 4096]
        differ = data[rows[1:]] != data[rows[:-1]]
        common[a : a + len(differ)] = np.where(differ.any(1), differ.argmax(1), data.shape[1])
    return order, common


def _padded(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of bytes with zeros at the end, and the same as big-endian words. Zeros decide nothing: only real bytes are asked for."""
    width = -(-width // 8) * 8
    raw = b"".join(p.ljust(width, b"\0") for p in parts)
    return np.frombuffer(raw, np.uint8).reshape(len(parts), width), np.frombuffer(raw, ">u8").reshape(len(parts), -1).astype(np.uint64)


def equal_windows(stretches: list[bytes], anchor: np.ndarray, length: int) -> np.ndarray:
    """Rows x windows: true where the window also stands in another row (`anchor`: its place in each stretch).

    Windows are compared only at equal distances from the anchor.
    """
    n, most = len(stretches), int(anchor.max(initial=0))
    count = np.array([len(s) - length + 1 for s in stretches], np.int64)
    out = np.zeros((n, int(count.max(initial=0))), bool)
    right, right_common = _neighbours(*_padded([s[a : a + length] for s, a in zip(stretches, anchor)], length)[::-1])
    left, left_common = _neighbours(*_padded([s[:a][::-1] for s, a in zip(stretches, anchor)], max(8, most))[::-1])
    right_run, left_run = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(most + 1):  # windows that begin d bytes before the anchor
        live = np.flatnonzero((d <= anchor) & (anchor - d < count))
        if len(live) > 1:
            right_run[right] = np.cumsum(right_common < length - d)
            left_run[left] = np.cumsum(left_common < d) if d else 0
            key = right_run[live] * (n + 1) + left_run[live]
            by_key = np.argsort(key, kind="stable")
            key = key[by_key]
            same = key[1:] == key[:-1]
            equal = live[by_key[np.append(same, False) | np.append(False, same)]]
            out[equal, anchor[equal] - d] = True
    return out


def _sorted_borders(borders: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, tk, i, n): runs of windows that also stand in another stretch."""
    n = max(partitions(borders.sparkSession), borders.count() // BUCKET + 1)
    lead = F.expr(f"substring(bytes, anchor + 1, {gram})")
    buckets = borders.select("*", lead.alias("lead")).repartitionByRange(n, "lead").drop("lead")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([*batches, pd.DataFrame(columns=["doc_id", "tk", "i", "anchor", "bytes"])], ignore_index=True)
        if not len(rows):
            return
        equal = equal_windows(rows["bytes"].tolist(), rows["anchor"].to_numpy(np.int64), length)
        edge = np.diff(np.pad(equal.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        row, begin = np.nonzero(edge == 1)
        _, end = np.nonzero(edge == -1)
        found = rows.iloc[row]
        yield pd.DataFrame({
            "doc_id": found["doc_id"].astype("Int64").to_numpy(), "tk": found["tk"].to_numpy(np.int32),
            "i": found["i"].to_numpy(np.int64) + begin, "n": end - begin})

    return buckets.mapInPandas(lean(compare), "doc_id bigint, tk int, i int, n int")


def _sorted_buckets(suffixes: DataFrame, length: int) -> DataFrame:
    """Repeated suffixes of each bucket (end false), and its first and last suffix (end true)."""
    n = partitions(suffixes.sparkSession)
    # id and place only break ties, so that splitters can fall among equal suffixes
    buckets = suffixes.repartitionByRange(n, "suffix", "doc_id", "i")

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([*batches, pd.DataFrame(columns=["doc_id", "tk", "i", "suffix"])], ignore_index=True)
        if not len(rows):
            return
        width = -(-length // 8) * 8
        raw = b"".join(s.ljust(width, b"\0") for s in rows["suffix"])
        order, group = multikey_quicksort(np.frombuffer(raw, ">u8").reshape(len(rows), -1).astype(np.uint64))
        rows, sizes = rows.iloc[order], np.bincount(group)
        repeated = sizes[group] > 1
        out = rows[repeated].assign(suffix=None, end=False)
        ends = rows.iloc[sorted({0, len(rows) - 1})].assign(end=True)
        out = pd.concat([out, ends], ignore_index=True)
        yield out.astype({"doc_id": "Int64", "tk": "int32", "i": "int32"})

    return buckets.mapInPandas(lean(sort), "doc_id bigint, tk int, i int, suffix binary, end boolean")


def repeats(docs: DataFrame, length: int = 200, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tk, i, n): stretches of n windows from byte i on, each of which also starts elsewhere.

    `tk` is a hash of the text that tells apart rows with one id. Rows that repeat whole count as copies of each other. Null
    texts are empty; matches never cross documents, and a document may match itself.
    """
    gram = max(1, length // 4)
    if not 2 <= length < 1 << 15:
        raise ValueError("length must be from 2 to 32767")
    keyed = _keyed(docs, doc_id, text)
    grams = stored(_gram_counts(keyed, length, gram).where("n > 1").select("kh"), "grams")
    candidates = stored(_stretches(keyed, length, gram, bit_map(grams, "kh", _map_bits(grams.count()))), "stretches")
    discard(grams)
    whole, few, many, distinct = _judged(candidates, "kh", "ch")
    used = [candidates, *distinct]
    windows = F.shiftright("shape", 16).alias("n")
    columns = ["doc_id", "tk", "i", "n"]
    listed = few.withColumn("frequent", F.lit(False)).unionByName(many.withColumn("frequent", F.lit(True)))
    texts, lists = _with_text(listed, keyed, ["i", "shape", "kh", "frequent"])
    pieces = stored(_pieces(texts, length), "borders")
    discard(lists)
    used.append(pieces)
    borders = pieces.where("bytes is not null").select("doc_id", "tk", "i", "anchor", "bytes")
    blocks = pieces.where("bytes is null").select("doc_id", "tk", "i", "n", "kh", "ch")
    parts = [whole.select("doc_id", "tk", "i", windows), _sorted_borders(borders, length, gram)]
    if not blocks.isEmpty():
        block_whole, block_few, block_many, block_distinct = _judged(blocks, "kh", "ch")
        open_ = block_few.unionByName(block_many)
        texts, lists = _with_text(open_, keyed, ["i", "n"])
        ends = stored(_sorted_buckets(_suffixes(texts, length), length), "suffixes")
        used += [*block_distinct, lists, ends]
        # a suffix at the end of as many buckets as it fills
        met = ends.where("end").groupBy("suffix").agg(F.count(F.lit(1)).alias("times"), F.collect_list(F.struct("doc_id", "tk", "i")).alias("rows"))
        met = met.where("times > 1").select(F.inline("rows"))
        single = F.lit(1).alias("n")
        parts += [block_whole.select(columns), ends.where("not end").select("doc_id", "tk", "i", single), met.select("doc_id", "tk", "i", single)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = stored(out, "repeats")
    discard(*used)
    return out


def _spans(rows, length: int) -> list[tuple[int, int]]:
    """Maximal runs [start, end) covered by windows."""
    out: list[list[int]] = []
    for i, n in sorted((r["i"], r["n"]) for r in rows):
        if out and i <= out[-1][1]:
            out[-1][1] = max(out[-1][1], i + n - 1 + length)
        else:
            out.append([i, i + n - 1 + length])
    return [(a, b) for a, b in out]


def _kept(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    places = [0, *(x for s in spans for x in s), len(data)]
    return b"".join(data[a:b] for a, b in zip(places[::2], places[1::2]))


def cleaned(docs: DataFrame, length: int = 200, doc_id: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """(row, kept, n_bytes, spans) of every row: the row as it was (a struct), the bytes left, their number before, and the
    removed [start, end) runs. With `decoded`, kept is a string, without what is left of characters that were cut."""
    found = repeats(docs, length, doc_id, text)
    lists = found.groupBy(F.col("doc_id").alias("_id"), F.col("tk").alias("_tk")).agg(F.collect_list(F.struct("i", "n")).alias("runs"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    key, content = F.col("row")[doc_id].cast("bigint"), F.col("row")[text]
    joined = rows.select("row", key.alias("key"), content.alias("text")).withColumn("tk", text_key())
    joined = joined.withColumn("may", _may_be_in(found.select("doc_id", "tk").distinct())("key", "tk"))
    kind, span_list = "string" if decoded else "binary", "array<struct<start: bigint, end: bigint>>"
    # texts without a repeat stay where they are, and stay whole: they need no second Python worker beside that of the map
    whole = F.coalesce("text", F.lit(""))
    alone = joined.where("not may").select("row", whole.cast(kind).alias("kept"), F.octet_length(whole).cast("bigint").alias("n_bytes"), F.array().cast(span_list).alias("spans"))
    joined = joined.where("may").join(lists.hint("merge"), F.col("key").eqNullSafe(F.col("_id")) & (F.col("tk") == F.col("_tk")), "left")

    @F.pandas_udf(f"struct<kept: {kind}, n_bytes: bigint, spans: {span_list}>")
    @lean
    def clean(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, lists in parts:
            data = [(t or "").encode() for t in texts]
            spans = [_spans(r, length) if r is not None else [] for r in lists]
            kept = [_kept(d, s) for d, s in zip(data, spans)]
            yield pd.DataFrame({
                "kept": [k.decode(errors="ignore") for k in kept] if decoded else kept, "n_bytes": [len(d) for d in data],
                "spans": [[{"start": a, "end": b} for a, b in s] for s in spans]})

    return joined.select("row", clean("text", "runs").alias("_r")).select("row", "_r.*").unionByName(alone)


def digests(docs: DataFrame, length: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    rows = cleaned(docs.select("doc_id", "text"), length)
    removed = F.col("n_bytes") - F.octet_length("kept")
    return rows.select(F.col("row.doc_id").alias("doc_id"), "n_bytes", removed.cast("bigint").alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
