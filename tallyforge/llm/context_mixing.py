"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is its bytes in lower case and one end symbol. Each byte is a path in a Huffman tree, so it takes a few binary choices
instead of eight. Every predictor hashes what stands before the byte (its last 3 or 4 bytes, or the current word so far) and
the tree's node to a slot with counts of both choices; the log-odds of the counts are its prediction. A mixer adds the log-odds
with weights from a set that a gate selects (how many of the long contexts were seen in training); what comes out is
refined by a table of how often such predictions came true. Weights and table start from a fit and then learn on: after each
block of a text a shift of all weight sets and the table are updated with what the block held, for that text alone, so scores
depend on no order and no partitioning.

Byte counts, word counts and slots are added up over all training documents, in tasks. The number of slots grows with the training
bytes up to 2**MOST_BITS per predictor, which bounds what is broadcast; word counts grow without a bound and meet the texts in a
join. The starting weights are a classifier fitted on all training documents, each scored with its own counts taken off the
slots: the mixer sees only a few bytes at each choice, so tasks count how often each such evidence comes, and Newton's method goes
over these counts.

Words are runs of characters other than blank, tab, line feed, vertical tab, form feed and return; each document's words are followed by one
end, a token like them. A null text is an empty one. Rows without an id are neither held out nor learned from; rows that repeat
are scored (and learned from) each. Nothing to learn from: every word is unknown, and all choices are even.
"""
from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import discard, lean, partitions, stored

#: Bytes before the current one in each predictor's context; the last predictor has the current word so far instead.
ORDERS = (3, 4)
PREDICTORS = len(ORDERS) + 1
#: Slots: one for every 64 training bytes, within these bounds.
LEAST_BITS, MOST_BITS = 16, 21
#: A word with more than this share of all training tokens travels with the tasks (there can be only so many); others are joined.
COMMON = 1 << 18
#: Log-odds are kept in eighteenths, from -7 to 7.
STEP = 18.0
GATES = 4
#: Choices after which a text's own evidence weighs as much as the fit.
KEEP = 8000.0
ODDS = 33
#: Bytes of history that contexts reach back, of a text taken at once, and of texts taken side by side.
REACH, SEGMENT, GROUP = 32, 1 << 16, 1 << 17
END = 255
#: Bytes of texts whose choices are looked up at once when the fit's evidence is counted.
SIDE = 1 << 16
CHUNK = 1 << 16
#: Bytes in contexts that are sorted at once, and how many of their paths are followed at once.
PAIRS, PATHS = 1 << 20, 1 << 15
#: Rows that a task hands back at once, and the different evidence that a row of the stored table holds.
HANDED, PACKED = 1 << 15, 1 << 15
#: Tasks whose slots one task adds up, where there are more.
FAN_IN = 64

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SPACE = np.zeros(256, bool)
SPACE[[0, 9, 10, 11, 12, 13, 32, END]] = True


# ---- choices ----

@dataclass(frozen=True)
class Code:
    """For each byte the nodes on its path and the choices there, one after the other; paths of a byte start at `start`."""

    length: np.ndarray
    start: np.ndarray
    step: np.ndarray  # 2 * node + choice


def huffman(counts: np.ndarray) -> Code:
    """Paths of least mean length for the counts (one is added to each); nodes are numbered from the root."""
    heap = [(int(c) + 1, i, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    children: dict[int, tuple] = {}
    fresh = 256
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        children[fresh] = (a[2], b[2])
        heapq.heappush(heap, (a[0] + b[0], fresh, fresh))
        fresh += 1
    paths: dict[int, list[tuple[int, int]]] = {}
    level, number = [(heap[0][2], [])], 0
    while level:
        below = []
        for item, path in level:
            if item < 256:
                paths[item] = path
            else:
                below += [(child, [*path, (number, bit)]) for bit, child in enumerate(children[item])]
                number += 1
        level = below
    length = np.array([len(paths[i]) for i in range(256)], np.int64)
    steps = [s for i in range(256) for s in paths[i]]
    return Code(length, np.concatenate([[0], np.cumsum(length)[:-1]]), np.array([2 * node + bit for node, bit in steps], np.int64))


def as_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER)


def laid_out(parts: list[tuple[bytes, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes a to b of texts with their ends, each after the REACH bytes before it (zeros at the start), and where they begin."""
    rows, begin, at = [], [], 0
    for data, a, b in parts:
        row = bytes(max(0, REACH - a)) + data[max(0, a - REACH) : b] + (bytes([END]) if b > len(data) else b"")
        rows.append(row)
        begin.append(at + REACH)
        at += len(row)
    return np.frombuffer(b"".join(rows), np.uint8), np.array(begin, np.int64)


def segments(n: int) -> list[tuple[int, int]]:
    """Bounds of the parts in which a text of n bytes is taken, its end included."""
    return [(a, min(a + SEGMENT, n + 1)) for a in range(0, n + 1, SEGMENT)]


_ODD = np.uint64(0x9E3779B97F4A7C15)
_LAID = 2 * (GROUP + SEGMENT)
_POWERS = np.cumprod(np.full(_LAID, _ODD, np.uint64))
_INVERSE = np.cumprod(np.full(_LAID, np.uint64(pow(int(_ODD), -1, 1 << 64)), np.uint64))


def _mixed(h: np.ndarray, bits: int) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    return ((h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - bits)).astype(np.int64)


def contexts(laid: np.ndarray, bits: int) -> np.ndarray:
    """First slot of each predictor's context (rows) at each byte that is laid out; the first REACH bytes have none."""
    wide = laid.astype(np.uint32)
    out = np.zeros((PREDICTORS, len(laid)), np.int64)
    seen = np.zeros(len(laid) - REACH, np.uint32)
    for k, order in enumerate(ORDERS):
        for back in range(ORDERS[k - 1] if k else 0, order):
            seen |= wide[REACH - 1 - back : len(laid) - 1 - back] << np.uint32(8 * back)
        out[k, REACH:] = _mixed(seen * np.uint32(2654435761) + np.uint32(order), bits)
    place = np.arange(len(laid))
    begin = np.maximum.accumulate(np.where(SPACE[laid], place + 1, 0))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((wide + np.uint32(1)) * _INVERSE[: len(laid)])])
    word = (sums[REACH:-1] - sums[begin[REACH - 1 : -1]]) * _POWERS[REACH : len(laid)]
    out[-1, REACH:] = _mixed((word >> np.uint64(32)).astype(np.uint32) ^ np.uint32(0x5BD1E995), bits)
    return out


def choices(code: Code, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(choices of each byte, their nodes, what was chosen) of bytes in their order."""
    times = code.length[data]
    ends = np.cumsum(times)
    at = np.repeat(code.start[data] - (ends - times), times) + np.arange(ends[-1] if len(ends) else 0)
    step = code.step.take(at, mode="clip")
    return times, step >> 1, step & 1


# ---- what is learned ----

@dataclass(frozen=True)
class Model:
    code: Code
    bits: int
    odds: np.ndarray  # predictors x slots, log-odds in steps; 0: not seen
    weights: np.ndarray  # predictors + 1 x gates; the last weight stands alone
    curve: np.ndarray  # of predictors + 1: mean curvature, for the size of updates
    table: np.ndarray  # 2 x ODDS: choices 1 and all choices at each log-odds


def slots(bits: int) -> int:
    return (1 << bits) + 256


def log_odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Rounded log-odds of counts; what was seen is never 0, what was not always is."""
    share = ones + np.float32(0.4)
    share /= zeros + np.float32(0.4)
    steps = np.log(share, out=share)
    steps *= np.float32(STEP)
    steps = np.clip(np.rint(steps, out=steps), -127, 127, out=steps).astype(np.int8)
    steps += steps == 0
    steps *= (zeros > 0) | (ones > 0)
    return steps


def learns(doc_id: str) -> Column:
    """True for documents to learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 != 1, F.lit(False))


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 1, F.lit(False))


def token_counts(rows: DataFrame) -> DataFrame:
    """(kind, key, n) over the texts of rows: words ("w"), ends ("e") and bytes ("b", end symbols included)."""
    def listed(words: Counter) -> Iterator[pd.DataFrame]:
        pairs = iter(words.items())
        while part := list(islice(pairs, HANDED)):
            yield pd.DataFrame({"kind": "w", "key": [w for w, _ in part], "n": [times for _, times in part]})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, chars, n = Counter(), np.zeros(256, np.int64), 0
        for batch in batches:
            texts = [as_bytes(t) for t in batch["text"]]
            for data in texts:
                words.update(data.split())
                chars += np.bincount(np.frombuffer(data, np.uint8), minlength=256)
            n += len(texts)
            if len(words) > 400_000:
                yield from listed(words)
                words.clear()
        chars[END] += n
        used = np.flatnonzero(chars)
        yield from listed(words)
        yield pd.DataFrame({"kind": "b", "key": [bytes([c]) for c in used], "n": chars[used]})
        yield pd.DataFrame({"kind": ["e"], "key": [b""], "n": [n]})

    return rows.mapInPandas(lean(count), "kind string, key binary, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _inside(n: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n places lie between a begin and its end."""
    edge = np.zeros(n + 1, np.int8)
    edge[begin] += 1
    edge[end] -= 1
    return np.cumsum(edge[:-1]).astype(bool)


def _groups_laid_out(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, begins, ends) of all parts of the texts, about GROUP bytes at once."""
    parts, size = [], 0
    for data in texts:
        for a, b in segments(len(data)):
            parts.append((data, a, b))
            size += b - a + REACH
            if size > GROUP:
                yield _laid(parts)
                parts, size = [], 0
    if parts:
        yield _laid(parts)


def _laid(parts: list[tuple[bytes, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    laid, begin = laid_out(parts)
    return laid, begin, begin + [b - a for _, a, b in parts]


def slot_counts(rows: DataFrame, code: Code, bits: int) -> DataFrame:
    """(chunk, at, n): of each CHUNK of entries those with a count (2-byte places) and their counts (8-byte integers); entries go
    predictor by predictor, choice 0 and 1 of a slot side by side."""
    size = 2 * slots(bits)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = np.zeros((PREDICTORS, size), np.uint32)
        waiting: list[np.ndarray] = []

        def add() -> None:
            """Equal bytes in equal contexts are counted by sorting, then each is one path."""
            for k in range(PREDICTORS):
                pairs = np.concatenate([w[k] for w in waiting])
                pairs.sort()
                new = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
                n = np.diff(np.append(new, len(pairs))).astype(np.uint32)
                pairs = pairs[new]
                for a in range(0, len(pairs), PATHS):
                    some = pairs[a : a + PATHS]
                    times, node, bit = choices(code, (some & 255).astype(np.int64))
                    np.add.at(found[k], np.repeat(2 * (some >> 8).astype(np.int64), times) + 2 * node + bit, np.repeat(n[a : a + PATHS], times))
            waiting.clear()

        for batch in batches:
            for laid, begin, ends in _groups_laid_out([as_bytes(t) for t in batch["text"]]):
                at = np.flatnonzero(_inside(len(laid), begin, ends))
                waiting.append((contexts(laid, bits)[:, at] << 8 | laid[at]).astype(np.uint32))
                if sum(w.shape[1] for w in waiting) > PAIRS:
                    add()
        if waiting:
            add()
        flat = found.ravel()
        for c in range(0, len(flat), CHUNK):
            at = np.flatnonzero(flat[c : c + CHUNK])
            if len(at):
                yield pd.DataFrame({"chunk": [c // CHUNK], "at": [at.astype(np.uint16).tobytes()], "n": [flat[c + at].astype(np.uint64).tobytes()]})

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, at, n in zip(batch["chunk"], batch["at"], batch["n"]):
                if c not in total:
                    total[c] = np.zeros(CHUNK, np.uint64)
                total[c][np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.uint64)
        for c, n in total.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"chunk": [c], "at": [at.astype(np.uint16).tobytes()], "n": [n[at].tobytes()]})

    chunks, schema = -(-PREDICTORS * size // CHUNK), "chunk int, at binary, n binary"
    partial = rows.mapInPandas(lean(count), schema)
    groups_ = rows.rdd.getNumPartitions() // FAN_IN
    if groups_ > 1:  # very many tasks: a task adds up the counts of FAN_IN of them first
        by_task = partial.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(groups_)))
        partial = by_task.repartition(partitions(rows.sparkSession), "chunk", "part").drop("part").mapInPandas(lean(add_up), schema)
    return partial.repartition(chunks, "chunk").mapInPandas(lean(add_up), schema)


def _gate(odds: np.ndarray) -> np.ndarray:
    """Number of seen contexts among the last three predictors."""
    return ((odds[-1] != 0).view(np.int8) + (odds[-2] != 0).view(np.int8) + (odds[-3] != 0).view(np.int8)).astype(np.int64)


def own_evidence(code: Code, bits: int, counts: np.ndarray, spare: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """What the mixer sees at each choice of counted texts, each text's own counts taken off the slots: the choice and the
    predictors' log-odds, a byte each. `spare` is zeros for all slots, and so again afterwards; it holds what a text counts of
    choice 0 in the lower half of a number and of choice 1 in the upper."""
    parts = []
    for laid, begin, ends in _groups_laid_out(texts):
        at = np.flatnonzero(_inside(len(laid), begin, ends))
        parts.append((*choices(code, laid[at]), contexts(laid, bits)[:, at]))
    times, node, bit = (np.concatenate([p[i] for p in parts]) for i in range(3))
    ends = np.cumsum(times)[np.cumsum([len(t) + 1 for t in texts]) - 1].tolist()
    key = np.empty((len(bit), 4), np.uint8)  # a little-endian number
    key[:, PREDICTORS] = bit
    one = np.int64(1) << (bit << 5)
    for k in range(PREDICTORS):
        slot = np.repeat(np.concatenate([p[3][k] for p in parts]), times)
        slot += node
        own = np.empty(len(slot), np.int64)
        for a, b in zip([0, *ends], ends):
            np.add.at(spare, slot[a:b], one[a:b])
            spare.take(slot[a:b], out=own[a:b], mode="clip")
            spare[slot[a:b]] = 0
        left = counts[k].view(np.int64).take(slot).view(np.float32)
        left -= own.view(np.int32).astype(np.float32)
        np.maximum(left, 0, out=left)
        np.add(log_odds(left[::2], left[1::2]).view(np.uint8), 128, out=key[:, PREDICTORS - 1 - k])
    return key.view("<u4").ravel()


def _tally(keys: list[np.ndarray]) -> pd.DataFrame:
    """Each different key and how often it comes. The list is empty afterwards, so that its arrays do not stay beside the sorted one."""
    key = np.concatenate(keys)
    keys.clear()
    key.sort()
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return pd.DataFrame({"key": key[new].astype(np.int64), "n": np.diff(np.append(new, len(key)))})


def _runs(texts: list[bytes], most: int) -> Iterator[list[bytes]]:
    """Texts in their order, about `most` bytes at once."""
    now, size = [], 0
    for t in texts:
        now.append(t)
        size += len(t) + 1
        if size > most:
            yield now
            now, size = [], 0
    if now:
        yield now


def _together(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """The tally of two tallies."""
    key, n = (np.concatenate([a[c].to_numpy(), b[c].to_numpy()]) for c in ("key", "n"))
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    return pd.DataFrame({"key": key[new], "n": np.add.reduceat(n[order], new) if len(key) else n})


def evidence(rows: DataFrame, code: Code, bits: int, counts: np.ndarray) -> DataFrame:
    """(key, n): how often each evidence (see `own_evidence`) comes with the choices of all texts of rows, PACKED at most to a row as
    arrays of 8-byte integers. That is all a fit needs."""
    sent = rows.sparkSession.sparkContext.broadcast(counts)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spare, waiting, size, total = np.zeros(slots(bits), np.int64), [], 0, pd.DataFrame({"key": np.empty(0, np.int64), "n": np.empty(0, np.int64)})
        for batch in batches:
            for texts in _runs([as_bytes(t) for t in batch["text"]], SIDE):
                waiting.append(own_evidence(code, bits, sent.value, spare, texts))
                size += len(waiting[-1])
                if size > PAIRS:
                    total, size = _together(total, _tally(waiting)), 0
                    if len(total) > PAIRS // 2:
                        yield from _cut(total, HANDED)
                        total = total.iloc[:0]
        if waiting:
            total = _together(total, _tally(waiting))
        yield from _cut(total, HANDED)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting = []
        for batch in batches:
            waiting.append(batch)
            if sum(map(len, waiting)) >= PACKED:
                yield _packed(waiting)
                waiting = []
        if sum(map(len, waiting)):
            yield _packed(waiting)

    found = rows.mapInPandas(lean(count), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    out = stored(found.mapInPandas(pack, "key binary, n binary"), "evidence")
    sent.unpersist()
    return out


def _cut(rows: pd.DataFrame, most: int) -> Iterator[pd.DataFrame]:
    return (rows.iloc[a : a + most] for a in range(0, len(rows), most))


def _packed(rows: list[pd.DataFrame]) -> pd.DataFrame:
    return pd.DataFrame({c: [np.concatenate([r[c].to_numpy(np.int64) for r in rows]).tobytes()] for c in ("key", "n")})


def _read(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log-odds with a last row of ones, choices, gates) of evidence."""
    own = np.stack([(key >> 8 * (PREDICTORS - 1 - k) & 255) - 128 for k in range(PREDICTORS)]).astype(np.int8)
    return np.vstack([own.astype(np.float64), np.ones(len(key))]), (key >> 8 * PREDICTORS).astype(np.float64), _gate(own)


def _chance(weights: np.ndarray, x: np.ndarray, gate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mix = (weights[:, gate] * x).sum(0)
    return mix, 1 / (1 + np.exp(-np.clip(mix, -30, 30)))


def newton_sums(weights: np.ndarray, key: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each gate the gradient and the curvature of the log-likelihood, one after the other."""
    x, y, gate = _read(key)
    _, p = _chance(weights, x, gate)
    out = []
    for g in range(GATES):
        own = gate == g
        a, times = x[:, own], n[own]
        out += [a @ (times * (y[own] - p[own])), ((a * (times * p[own] * (1 - p[own]))) @ a.T).ravel()]
    return np.concatenate(out)


def outcome_sums(weights: np.ndarray, key: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Number of choices, curvature of each weight, and the choices 1 and all choices at each log-odds."""
    x, y, gate = _read(key)
    mix, p = _chance(weights, x, gate)
    spot = _spot(mix)
    tables = [np.bincount(spot, weights=w, minlength=ODDS) for w in (y * n, n)]
    return np.concatenate([[n.sum()], (x * x * (n * p * (1 - p))).sum(1), *tables])


def sums_over(found: DataFrame, sums: Callable[..., np.ndarray], weights: np.ndarray) -> np.ndarray | None:
    """sums(weights, key, n) over all evidence (rows of arrays), added up; tasks return one array each."""
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = 0
        for batch in batches:
            for key, n in zip(batch["key"], batch["n"]):
                total = total + sums(weights, np.frombuffer(key, np.int64), np.frombuffer(n, np.int64).astype(np.float64))
        if not np.isscalar(total):
            yield pd.DataFrame({"sums": [total]})

    parts = found.mapInPandas(add, "sums array<double>").collect()
    return np.array([math.fsum(column) for column in zip(*(r["sums"] for r in parts))]) if parts else None


def fitted(code: Code, bits: int, counts: np.ndarray, texts: list[bytes]) -> Model:
    """Model of the slots' counts (predictors x 2 * slots), its mixer fitted on the texts, which are among those counted."""
    counts, spare = np.ascontiguousarray(counts, np.float32), np.zeros(slots(bits), np.int64)
    found = _tally([own_evidence(code, bits, counts, spare, run) for run in _runs(texts, SIDE)]) if texts else None
    return fit(code, bits, counts, lambda sums, weights: None if found is None else sums(weights, found["key"].to_numpy(), found["n"].to_numpy(np.float64)))


def fit(code: Code, bits: int, counts: np.ndarray, total: Callable[[Callable[..., np.ndarray], np.ndarray], np.ndarray | None]) -> Model:
    """Model of the slots' counts, its mixer fitted by Newton's method; total(sums, weights) adds up over the evidence."""
    odds = np.stack([log_odds(c[::2], c[1::2]) for c in counts])
    size = PREDICTORS + 1
    start = np.concatenate([np.full(PREDICTORS, 0.3 / STEP), [0.0]])
    weights, curve = np.tile(start[:, None], GATES), np.append(np.full(PREDICTORS, 0.1 * STEP**2), 0.1)
    table = np.stack([1 / (1 + np.exp(-_centres())), np.ones(ODDS)]) * 20.0
    ridge = np.diag(np.append(np.full(PREDICTORS, STEP**2), 1.0))
    reach = 0.5 / np.append(np.full(PREDICTORS, STEP), 1.0)
    for _ in range(15):
        found = total(newton_sums, weights)
        if found is None:  # nothing to learn from
            return Model(code, bits, odds, weights.astype(np.float32), curve, table)
        steps = np.zeros_like(weights)
        for g, own in enumerate(found.reshape(GATES, -1)):
            pull, bend = own[:size], own[size:].reshape(size, size)
            steps[:, g] = np.clip(np.linalg.solve(bend + ridge, pull - ridge @ (weights[:, g] - start)), -reach, reach)
        weights = weights + steps
        if (np.abs(steps) < 1e-9).all():
            break
    found = total(outcome_sums, weights)
    curve = np.maximum(found[1 : size + 1] / found[0], curve / 100)
    return Model(code, bits, odds, weights.astype(np.float32), curve, table + found[size + 1 :].reshape(2, ODDS))


def _centres() -> np.ndarray:
    return (np.arange(ODDS) - ODDS // 2) / 2


def _spot(odds: np.ndarray) -> np.ndarray:
    return (np.clip(odds, -8, 8) * 2 + (ODDS // 2 + 0.5)).astype(np.int64)


# ---- scoring ----

def block_ends(a: int, b: int) -> list[int]:
    """Ends of the blocks of bytes a to b of a text: 512, 1024, ... up to 4096 bytes each from the text's start."""
    ends, at, size = [], 0, 512
    while at < b:
        at += size
        if at > a:
            ends.append(min(at, b))
        size = min(2 * size, 4096)
    return ends


class Lanes:
    """What texts that are scored side by side have learned: a shift of the weights, and how often predictions came true."""

    def __init__(self, model: Model, n: int):
        self.shift = np.zeros((PREDICTORS + 1, n), np.float32)
        self.seen = np.full(n, KEEP)
        # the fit's evidence at each log-odds counts as 60 choices at most
        self.table = np.repeat((model.table * np.minimum(1, 60 / model.table[1]))[:, None, :], n, axis=1)
        self.total = np.zeros(n)

    def step(self, model: Model, slot: list[np.ndarray], bit: np.ndarray, lanes: np.ndarray, size: np.ndarray) -> None:
        """Adds the log probability of the choices, `size` of each lane, as predicted from what the lanes know; then they learn from them."""
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        seen = [model.odds[k].take(slot[k]) for k in range(PREDICTORS)]
        which = np.repeat(np.arange(0, GATES * len(lanes), GATES), size) + _gate(seen)
        weights = (model.weights[:, None, :] + self.shift[:, lanes, None]).reshape(PREDICTORS + 1, -1)
        odds = [s.astype(np.float32) for s in seen]
        mix = weights[-1].take(which, mode="clip")
        for k in range(PREDICTORS):
            mix += odds[k] * weights[k].take(which, mode="clip")
        np.clip(mix, -12, 12, out=mix)
        p = np.exp(-mix)
        p += 1
        np.reciprocal(p, out=p)
        spot = np.repeat(np.arange(0, ODDS * len(lanes), ODDS), size) + _spot(mix)
        share = (self.table[0, lanes] / self.table[1, lanes]).astype(np.float32).ravel()
        refined = share.take(spot, mode="clip")
        refined += p
        refined *= np.float32(0.5)
        # the probability of what was chosen: refined for 1, 1 - refined for 0
        chosen = bit.astype(np.float32)
        refined -= 1 - chosen
        np.abs(refined, out=refined)
        self.total[lanes] += np.add.reduceat(np.log(refined, out=refined), first, dtype=np.float64)
        miss = chosen - p
        self.seen[lanes] += size
        pace = (PREDICTORS / 2) * model.curve[:, None] * self.seen[lanes]
        pull = np.stack([*(np.add.reduceat(odds[k] * miss, first) for k in range(PREDICTORS)), np.add.reduceat(miss, first)])
        self.shift[:, lanes] += pull / pace
        hits = np.bincount(2 * spot + bit, minlength=2 * ODDS * len(lanes)).reshape(len(lanes), ODDS, 2)
        self.table[0, lanes] += hits[:, :, 1]
        self.table[1, lanes] += hits.sum(2)


def text_scores(model: Model, texts: list[bytes]) -> np.ndarray:
    """log10 probability of each text with its end; each learns for itself, from the same start."""
    lanes = Lanes(model, len(texts))
    for nth in range(max((len(segments(len(t))) for t in texts), default=0)):
        live = [i for i, t in enumerate(texts) if nth * SEGMENT <= len(t)]
        bounds = [segments(len(texts[i]))[nth] for i in live]
        laid, begin = laid_out([(texts[i], a, b) for i, (a, b) in zip(live, bounds)])
        slot = contexts(laid, model.bits)
        ends = [block_ends(a, b) for a, b in bounds]
        for step in range(max(map(len, ends))):
            now = [j for j in range(len(live)) if step < len(ends[j])]
            cut = [(ends[j][step - 1] if step else bounds[j][0], ends[j][step]) for j in now]
            size = np.array([b - a for a, b in cut])
            start = np.array([begin[j] + a - bounds[j][0] for j, (a, _) in zip(now, cut)])
            first = np.concatenate([[0], np.cumsum(size)[:-1]])
            at = np.repeat(start - first, size) + np.arange(size.sum())
            times, node, bit = choices(model.code, laid[at])
            lanes.step(model, [np.repeat(s[at], times) + node for s in slot], bit, np.array(live)[now], np.add.reduceat(times, first))
    return lanes.total / np.log(10)


def groups(texts: list[bytes], most: int = GROUP) -> Iterator[list[int]]:
    """Numbers of texts to score side by side, of like lengths."""
    now, size = [], 0
    for i in sorted(range(len(texts)), key=lambda i: len(texts[i])):
        if now and size + len(texts[i]) > most:
            yield now
            now, size = [], 0
        now.append(i)
        size += len(texts[i]) + 64
    if now:
        yield now


def trained(rows: DataFrame) -> tuple[Model, DataFrame, int, int, int]:
    """(model, stored word counts, ends, tokens, distinct tokens) of rows with a text column."""
    spark = rows.sparkSession
    counted = stored(token_counts(rows), "token-counts")
    words = counted.where("kind = 'w'").select("key", "n")
    n_words, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    ends = sum(r["n"] for r in counted.where("kind = 'e'").collect())
    chars = np.zeros(256, np.int64)
    for r in counted.where("kind = 'b'").collect():
        chars[r["key"][0]] = r["n"]
    code = huffman(chars)
    bits = int(np.clip(int(chars.sum() // 64).bit_length(), LEAST_BITS, MOST_BITS))
    size = 2 * slots(bits)
    flat = np.zeros(-(-PREDICTORS * size // CHUNK) * CHUNK, np.float32)
    for r in slot_counts(rows, code, bits).repartition(16).toLocalIterator():  # a sixteenth at a time
        flat[r["chunk"] * CHUNK + np.frombuffer(r["at"], np.uint16).astype(np.int64)] = np.frombuffer(r["n"], np.uint64)
    counts = flat[: PREDICTORS * size].reshape(PREDICTORS, size)
    found = evidence(rows, code, bits, counts)
    model = fit(code, bits, counts, lambda sums, weights: sums_over(found, sums, weights))
    discard(found)
    return model, counted, ends, n_words + ends, distinct + (ends > 0)


def scored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), held_out(doc_id).alias("held_out"), learns(doc_id).alias("_learn"))
    model, counted, ends, tokens, distinct = trained(rows.where("_learn").select("doc_id", "text"))
    words = counted.where("kind = 'w'").select("key", "n")
    often = words.where(F.col("n") * COMMON > tokens).toArrow()  # fewer than COMMON
    common = dict(zip(often["key"].to_pylist(), often["n"].to_pylist()))
    whole = float(np.log10(tokens + 0.5 * (distinct + 1)))
    sent, known = spark.sparkContext.broadcast(model), spark.sparkContext.broadcast(common)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chance = {w: (n, float(np.log10(n + 0.5)) - whole) for w, n in known.value.items()}
        of_end = float(np.log10(ends + 0.5)) - whole
        for batch in batches:
            texts = [as_bytes(t) for t in batch["text"]]
            result = np.zeros(len(texts))
            for own in groups(texts):
                result[own] = text_scores(sent.value, [texts[i] for i in own])
            out = []
            for data in texts:
                n, found, base, rare = 1, int(ends > 0), of_end, []
                for w, times in Counter(data.split()).items():
                    n += times
                    c = chance.get(w)
                    if c is None:
                        rare.append((w, times))
                    else:
                        found, base = found + times, base + times * c[1]
                out.append((n, found, base, [w for w, _ in rare], [t for _, t in rare]))
            own = pd.DataFrame(out, columns=["n_tokens", "found", "base", "rare", "times"])
            bits = -result / np.log10(2) / [len(t) + 1 for t in texts]
            yield own.assign(doc_id=batch["doc_id"].to_numpy(), held_out=batch["held_out"].to_numpy(), score=result, bits_per_byte=bits)

    kind = docs.schema[doc_id].dataType.simpleString()
    fields = f"doc_id {kind}, held_out boolean, score double, bits_per_byte double, n_tokens bigint, found bigint, base double, rare array<binary>, times array<int>"
    texts = rows.select("doc_id", "text", "held_out").mapInPandas(lean(score), fields).withColumn("uid", F.monotonically_increasing_id())
    texts = stored(texts, "text-scores")
    rare = texts.select("uid", F.inline(F.arrays_zip(F.col("rare").alias("key"), F.col("times").alias("times"))))
    met = rare.join(words.where(F.col("n") * COMMON <= tokens), "key", "left")
    of_word = F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5)) - F.lit(whole)
    sums = met.groupBy("uid").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("more"), F.sum(F.col("times") * of_word).alias("plus"))
    out = texts.join(sums, "uid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("found") + zero("more")).alias("n_known"), F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + zero("plus")).alias("base_score"), "score", "bits_per_byte")
