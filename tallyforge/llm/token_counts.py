"""Token counts that follow edits without encoding a text anew.

A text is cut into leaves of some pre-tokens each; a segment tree per document sums the leaves' characters and tokens. The tree
is two columns of the document's row: places 1, 2-3, 4-7 ... are the levels, the last level the leaves. An edit goes down the
tree to the leaf it begins in, reads pre-tokens from a leaf border safely before it until it meets an old border behind it, and
counts only those; sums change on the way up. What lies on either side is not looked at.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.tokens import TokenCache, token_cache

#: Pieces (of one or more pre-tokens) in a new leaf; a region that has come to more than four times its leaves' share is cut anew.
LEAF = 32
#: A pre-token's end depends on at most this many characters after it.
AHEAD = 2

TREE = "struct<chars: array<int>, tokens: array<int>, leaves: int>"
EDIT = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("insert", T.StringType())])


def _tree(leaves: np.ndarray) -> np.ndarray:
    """Sums of leaves in heap order; place 0 is unused."""
    size = 1 << max(0, int(len(leaves) - 1).bit_length())
    out = np.zeros(2 * size, np.int32)
    out[size : size + len(leaves)] = leaves
    at = size
    while at > 1:
        out[at // 2 : at] = out[at : 2 * at : 2] + out[at + 1 : 2 * at : 2]
        at //= 2
    return out


def _leaves(chars: np.ndarray, tokens: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Pieces summed in `groups` runs of nearly equal length (empty ones if there are fewer pieces)."""
    cuts = np.linspace(0, len(chars), groups + 1).astype(int)
    sums = [np.concatenate([[0], np.cumsum(x)])[cuts] for x in (chars, tokens)]
    return np.diff(sums[0]), np.diff(sums[1])


@dataclass
class Counted:
    """A text with its tree."""

    text: str
    chars: np.ndarray
    tokens: np.ndarray
    leaves: int
    read: int = field(default=0)

    @classmethod
    def build(cls, text: str, cache: TokenCache, pattern: str) -> Counted:
        chars, tokens = measured(text, cache, pattern)
        leaves = -(-len(chars) // LEAF)
        chars, tokens = _leaves(chars, tokens, leaves)
        return cls(text, _tree(chars), _tree(tokens), leaves)

    @property
    def n_tokens(self) -> int:
        return int(self.tokens[1])

    def _find(self, place: int) -> tuple[int, int]:
        """(leaf, its first character): the last leaf that begins at or before `place`."""
        at, first, size = 1, 0, len(self.chars) // 2
        while at < size:
            left = int(self.chars[2 * at])
            # an empty right half begins where the text ends; leaves past the last are empty
            step = place - first >= left and int(self.chars[2 * at + 1]) > 0
            at, first = 2 * at + step, first + left * step
        return at - size, first

    def edit(self, start: int, length: int, insert: str, cache: TokenCache, pattern: str) -> None:
        """Replaces `length` characters from `start` by `insert`; places beyond the text count as its end."""
        size = len(self.text)
        start = min(max(start, 0), size)
        stop = min(start + max(length, 0), size)
        if start == stop and not insert:
            return
        self.text = self.text[:start] + insert + self.text[stop:]
        moved = len(insert) - (stop - start)
        if not self.leaves:
            self._cut_anew(cache, pattern)
            return
        first, begin = self._find(max(0, start - AHEAD - 1))
        half = len(self.chars) // 2
        # borders of old leaves behind the edit, as places of the new text
        leaf, border = first, begin
        chars, tokens, end = [], [], begin
        scan = scanner(self.text, begin, pattern)
        while True:
            while leaf < self.leaves and (border < stop or border + moved < end):
                border += int(self.chars[half + leaf])
                leaf += 1
            if end >= start + len(insert) and end == border + moved:
                break
            piece = next(scan, None)
            if piece is None:
                leaf = self.leaves
                break
            chars.append(len(piece))
            tokens.append(piece)
            end += len(piece)
        counts = cache.sizes(tokens)
        self.read += len(chars)
        groups = leaf - first
        if len(chars) > 4 * LEAF * max(1, groups) or groups == 0:
            self._cut_anew(cache, pattern, first, leaf, np.array(chars, np.int64), counts)
            return
        for tree, leaves in zip((self.chars, self.tokens), _leaves(np.array(chars, np.int64), counts, groups)):
            tree[half + first : half + leaf] = leaves
            low, high = (half + first) // 2, (half + leaf - 1) // 2
            while low:
                tree[low : high + 1] = tree[2 * low : 2 * high + 2 : 2] + tree[2 * low + 1 : 2 * high + 2 : 2]
                low, high = low // 2, high // 2

    def _cut_anew(self, cache: TokenCache, pattern: str, first: int = 0, last: int = 0, chars=None, counts=None) -> None:
        """New leaves for the pieces read in place of leaves first to last, and a new tree above all leaves."""
        if chars is None:
            chars, counts = measured(self.text, cache, pattern)
            self.read += len(chars)
        half = len(self.chars) // 2
        new = _leaves(chars, counts, -(-len(chars) // LEAF))
        old = [tree[half : half + self.leaves] for tree in (self.chars, self.tokens)]
        joined = [np.concatenate([o[:first], n, o[last:]]) for o, n in zip(old, new)]
        self.chars, self.tokens, self.leaves = _tree(joined[0]), _tree(joined[1]), len(joined[0])


def scanner(text: str, begin: int, pattern: str) -> Iterator[str]:
    import regex

    return (m[0] for m in regex.compile(pattern).finditer(text, begin))


def measured(text: str, cache: TokenCache, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """(characters, tokens) of each piece of a text."""
    pieces = cache.cut_plain(text)
    if pieces is None:
        pieces = list(scanner(text, 0, pattern))
    return np.fromiter(map(len, pieces), np.int64, len(pieces)), cache.sizes(pieces)


def tree(vocabulary: str, pattern: str, text: Column | str = "text") -> Column:
    """The segment tree of a text (null: empty), as a struct column to be kept with it."""
    @F.pandas_udf(TREE)
    def build(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cache = token_cache(vocabulary)
        for part in texts:
            found = [Counted.build(t or "", cache, pattern) for t in part]
            yield pd.DataFrame({"chars": [c.chars for c in found], "tokens": [c.tokens for c in found], "leaves": np.array([c.leaves for c in found], np.int32)})

    return build(F.col(text) if isinstance(text, str) else text)


def n_tokens(tree: Column | str = "tree") -> Column:
    """A tree's token count: its root."""
    tree = F.col(tree) if isinstance(tree, str) else tree
    return F.coalesce(F.get(tree["tokens"], F.lit(1)), F.lit(0)).cast("bigint")


def apply_edits(docs: DataFrame, edits: DataFrame, vocabulary: str, pattern: str, doc_id: str = "doc_id", text: str = "text", tree: str = "tree") -> DataFrame:
    """(doc_id, text, tree, n_edits, n_read) of every document after its edits (doc_id, seq, start, length, insert).

    Edits of a document follow each other by `seq`, each on the text the one before left; equal edits count once. A null or
    negative start or length is 0, a null insert empty; edits of unknown documents do nothing. Rows that share an id all get its
    edits, null ids those of null. `n_read` is the number of pieces counted again.
    """
    fields = [F.coalesce(F.col(c).cast("bigint"), F.lit(0)).alias(c) for c in ("seq", "start", "length")]
    change = F.struct(*fields, F.coalesce("insert", F.lit("")).alias("insert"))
    lists = edits.groupBy(F.col("doc_id").alias("_id")).agg(F.array_sort(F.collect_set(change)).alias("edits"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(tree).alias("tree"))
    joined = rows.join(lists, F.col("doc_id").eqNullSafe(F.col("_id")), "left")

    @F.pandas_udf(f"struct<text: string, tree: {TREE}, n_edits: int, n_read: int>")
    def change_all(parts: Iterator[tuple[pd.Series, pd.DataFrame, pd.Series]]) -> Iterator[pd.DataFrame]:
        cache = token_cache(vocabulary)
        for texts, trees, lists in parts:
            out = []
            for t, chars, tokens, leaves, changes in zip(texts, trees["chars"], trees["tokens"], trees["leaves"], lists):
                doc = Counted(t, np.array(chars, np.int32), np.array(tokens, np.int32), int(leaves))
                for e in changes if changes is not None else ():
                    doc.edit(e["start"], e["length"], e["insert"], cache, pattern)
                out.append((doc.text, {"chars": doc.chars.tolist(), "tokens": doc.tokens.tolist(), "leaves": doc.leaves}, 0 if changes is None else len(changes), doc.read))
            yield pd.DataFrame(out, columns=["text", "tree", "n_edits", "n_read"])

    return joined.select("doc_id", change_all("text", "tree", "edits").alias("_r")).select("doc_id", "_r.*")
