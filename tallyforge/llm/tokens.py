"""Token ids from vocabulary files of the tokenizers library, with a bounded memory of words already encoded.

Both vocabularies cut a text into pre-tokens before any merge, so the ids of a text are the ids of its pre-tokens, joined.
`TokenCache` cuts at places that are pre-token borders for certain (beside a run of plain letters, or before white space),
asks the library for each new piece once (plain words go straight to its model, if that gives the same ids), and keeps the answers up to a fixed number of pieces. Texts with characters
outside ASCII and Latin letters go to the library whole.
"""
from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from itertools import chain, repeat

import numpy as np

from tallyforge.llm.shared import kept

#: Beyond these characters, Python's classes and the vocabulary's may differ.
_PLAIN = re.compile(r"[^\x00-\x1b\x20-\x7fÀ-ɏ]")
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_LETTER = "[A-Za-zÀ-ÖØ-öø-ɏ]"
#: A run of letters with the space before it, a mark that ends a word, or all up to the next white space.
_PIECES = re.compile(rf" ?{_LETTER}++(?!')|(?<={_LETTER})[.,;:!?](?=[ \n])|\s*\S+|\s+")
#: The same for vocabularies to which white space and capitals mean nothing.
_LOOSE_PIECES = re.compile(rf"{_LETTER}++(?!')|(?<={_LETTER})[.,;:!?](?=\s)|\S+")
_WORD = re.compile(rf" ?{_LETTER}+")
_BATCH = 64


class TokenCache:
    """Encodes texts as unsigned ids; `pieces` bounds how many pieces are remembered, the latest used stay."""

    def __init__(self, path: str, pieces: int = 800_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True
        self.dtype = np.dtype("<u2") if self.lib.get_vocab_size() <= 65536 else np.dtype("<u4")
        self.pieces = pieces
        self.loose = self._list("hello") == self._list(" Hello") and self._list("a\n b") == self._list("A b ")
        self.cut = _LOOSE_PIECES.findall if self.loose else _PIECES.findall
        self.letters = self._letters()
        self.index: dict[str, int] = {}
        self.batch = self.n_ids = 0
        self.flat = np.empty(1 << 16, self.dtype)  # ids of all pieces, and each piece's part of them
        self.start, self.size, self.used = (np.zeros(1 << 14, np.int32) for _ in range(3))

    def _list(self, text: str) -> list[int]:
        return self.lib.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _letters(self) -> dict[int, str] | None:
        """How the vocabulary's model sees a space and each plain letter, if words may go to it without the steps before it."""
        plain = [c for c in map(chr, range(0x250)) if _WORD.fullmatch(c) and (c == c.lower() or not self.loose)]
        seen = {ord(c): "".join(part for part, _ in self.lib.pre_tokenizer.pre_tokenize_str(c)) for c in plain}
        if not self.loose:
            seen[ord(" ")] = self.lib.pre_tokenizer.pre_tokenize_str(" a")[0][0][:-1]
        samples = [w.lower() if self.loose else " " * (i % 2) + w for i, w in enumerate(["Hello", "world", "déjà", "Straße", "a", "É", *("x" + c for c in plain)])]
        agree = all([t.id for t in self.lib.model.tokenize(w.translate(seen))] == self._list(w) for w in samples)
        return seen if agree else None

    def _add(self, pieces: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        n, total = len(self.index), len(self.index) + len(pieces)
        while total > len(self.start):
            self.start, self.size, self.used = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size, self.used))
        while self.n_ids + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.n_ids : self.n_ids + len(ids)] = ids
        self.start[n:total] = self.n_ids + np.cumsum(sizes) - sizes
        self.size[n:total] = sizes
        self.n_ids += len(ids)
        self.index.update(zip(pieces, range(n, total)))

    def _learn(self, pieces: list[str]) -> None:
        words = [p for p in pieces if _WORD.fullmatch(p)] if self.letters else []
        if words:
            tokenize = self.lib.model.tokenize
            found = [[t.id for t in tokenize(w.translate(self.letters))] for w in words]
            self._add_lists(words, found)
            pieces = [p for p in pieces if p not in self.index]
        if pieces:
            self._add_lists(pieces, [x.ids for x in self.lib.encode_batch_fast(pieces, add_special_tokens=False)])

    def _add_lists(self, pieces: list[str], found: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self._add(pieces, sizes, np.fromiter(chain.from_iterable(found), self.dtype, int(sizes.sum())))

    def _forget(self) -> None:
        """Keeps the half of the pieces used last."""
        n = len(self.index)
        kept = self.used[:n] > np.median(self.used[:n])
        pieces = [p for p, k in zip(self.index, kept.tolist()) if k]
        sizes, used = self.size[:n][kept], self.used[:n][kept]
        ids = self.flat[np.repeat(self.start[:n][kept] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
        self.index, self.n_ids = {}, 0
        self._add(pieces, sizes, ids)
        self.used[: len(pieces)] = used

    def _places(self, pieces: Sequence[str]) -> np.ndarray:
        """Numbers of the pieces, all of them known afterwards."""
        found = np.fromiter(map(self.index.get, pieces, repeat(-1)), np.int32, len(pieces))
        new = np.flatnonzero(found < 0).tolist()
        if new:
            learned = list(dict.fromkeys([pieces[i] for i in new]))
            if self.index and len(self.index) + len(learned) > self.pieces:
                self._forget()
                return self._places(pieces)
            self._learn(learned)
            found[new] = [self.index[pieces[i]] for i in new]
        self.batch += 1
        self.used[found] = self.batch
        return found

    def cut_plain(self, text: str) -> list[str] | None:
        """Pieces of a text, none of which begins or ends inside a pre-token; None if its characters do not allow it."""
        strange = any(c in text for c in _SEPARATORS) if text.isascii() else _PLAIN.search(text)
        return None if strange else self.cut(text.lower() if self.loose else text)

    def sizes(self, pieces: Sequence[str]) -> np.ndarray:
        """Number of ids of each piece."""
        places = self._places(pieces)
        return self.size[places]

    def whole(self, text: str) -> np.ndarray:
        """The library's own answer for a text, without the memory."""
        return np.array(self._list(text), self.dtype)

    def ids(self, texts: Sequence[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text, in order; null counts as empty."""
        for start in range(0, len(texts), _BATCH):
            part = [t or "" for t in texts[start : start + _BATCH]]
            cut = [self.cut_plain(t) for t in part]
            places = self._places(list(chain.from_iterable(c for c in cut if c)))
            sizes = self.size[places]
            ends = np.cumsum(sizes, dtype=np.int32)
            flat = self.flat[np.repeat(self.start[places] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)]
            ends = np.append(0, ends)
            piece = 0
            for text, pieces in zip(part, cut):
                if pieces is None:
                    yield self.whole(text)
                else:
                    yield flat[ends[piece] : ends[piece + len(pieces)]]
                    piece += len(pieces)


def token_cache(path: str, pieces: int = 800_000) -> TokenCache:
    """The one memory of this Python worker for a vocabulary."""
    return kept(("tokens", path, pieces), lambda: TokenCache(path, pieces))
