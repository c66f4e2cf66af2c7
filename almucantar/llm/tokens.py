"""Token ids of whole texts by the public tokenizers, fast enough for invented and rare words.

A text is cut where the tokenizer's own pre-tokenizer always cuts (at single blanks and line ends), each
different piece is encoded once by the ``tokenizers`` library and the ids are put together with numpy.
Texts for which such cuts could differ (white space in runs, strings that look like special tokens) are
encoded as a whole.
"""

from __future__ import annotations

import os
import zlib
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from almucantar.llm import shared

#: Pieces, and characters of them, that an encoder remembers before it forgets the rare ones; and the longest that it keeps then.
MOST_PIECES, MOST_CHARS, LONG_PIECE = 500_000, 16 << 20, 200
#: Text bytes that are encoded at once.
BATCH = 4 << 20
_SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_CUT = "\x1f"
#: What stands between pieces that go to a word tokenizer as one text, and how many do.
_MARK, JOINED = "\x01", 128


class Encoder:
    """Encodes arrays of texts; one per Python worker.

    ``keeps_space``: a blank belongs to the word after it (byte-level BPE); else white space is dropped
    and letters are lower-cased by the tokenizer (word BPE).
    """

    def __init__(self, path: str, keeps_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keeps_space = keeps_space
        mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 and not keeps_space else None
        self._whole = rf"{_SPACE}{{2}}|<\||{_CUT}" if keeps_space else r"<\|"
        self.known: dict[str, int] = {"": 0}
        self.chars = 0
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length, self.seen = (np.zeros(1 << 14, np.int64) for _ in range(3))

    def _forget(self) -> None:
        """Drops the pieces that only one array of texts had, or all if that leaves too many."""
        n = len(self.known)
        keep = self.seen[:n] > 1
        keep &= np.fromiter((len(p) <= LONG_PIECE for p in self.known), bool, n)
        keep[0] = True
        if keep.sum() > MOST_PIECES // 2:
            keep[1:] = False
        lengths = self.length[:n][keep]
        starts = np.cumsum(lengths) - lengths
        take = np.repeat(self.start[:n][keep] - starts, lengths) + np.arange(int(lengths.sum()))
        self.known = {p: i for i, p in enumerate(p for p, k in zip(self.known, keep, strict=True) if k)}
        self.flat, self.used = self.flat[take].copy() if len(take) else np.zeros(1 << 16, np.uint32), len(take)
        self.start, self.length, self.seen = starts, lengths, np.ones(len(lengths), np.int64)
        self.chars = sum(map(len, self.known))

    def _add(self, pieces: list[str]) -> None:
        for at in range(0, len(pieces), 20_000):
            some = pieces[at : at + 20_000]
            lengths, new = self._encoded(some)
            if self.used + len(new) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(len(self.flat) + len(new), np.uint32)])
            first = len(self.known)
            if first + len(some) > len(self.start):
                more = np.zeros(len(self.start) + len(some), np.int64)
                self.start, self.length, self.seen = (np.concatenate([x, more]) for x in (self.start, self.length, self.seen))
            self.flat[self.used : self.used + len(new)] = new
            self.length[first : first + len(some)] = lengths
            self.start[first : first + len(some)] = self.used + np.cumsum(lengths) - lengths
            self.used += len(new)
            self.chars += sum(map(len, some))
            self.known.update(zip(some, range(first, first + len(some)), strict=True))

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each piece has, and the ids of all.

        White space always parts words, so many pieces are encoded as one text, in which a mark's id ends each. A piece
        that has this id itself makes too many marks; then each piece is encoded alone.
        """
        if self.mark is not None:
            ids, _ = self._listed([f" {_MARK} ".join([*pieces[i : i + JOINED], ""]) for i in range(0, len(pieces), JOINED)])
            is_mark = ids == self.mark
            ends = np.flatnonzero(is_mark)
            if len(ends) == len(pieces):
                return np.diff(ends, prepend=-1) - 1, ids[~is_mark]
        ids, lengths = self._listed(pieces)
        return lengths, ids

    def _listed(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())), lengths

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's begin (one more than texts). Null: empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = pc.match_substring_regex(texts, self._whole)
        slow = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        cut = pc.if_else(whole, "", texts) if len(slow) else texts
        if self.keeps_space:
            cut = pc.replace_substring(pc.replace_substring(cut, " ", _CUT + " "), "\n", f"{_CUT}\n{_CUT}")
            lists = pc.split_pattern(cut, _CUT)
        else:
            own = cut.take(pa.array(np.arange(len(cut))))  # ascii_lower goes wrong on a slice whose offsets do not begin at 0
            lists = pc.split_pattern(pc.replace_substring(pc.ascii_lower(own), "\n", " "), " ")
        at = lists.offsets.to_numpy()
        coded = lists.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        if len(self.known) > MOST_PIECES or self.chars > MOST_CHARS:
            self._forget()
        own = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = own < 0
        own[new] = len(self.known) + np.arange(new.sum())  # the numbers that they get
        self._add(list(compress(pieces, new.tolist())))
        self.seen[own] += 1
        place = own[coded.indices.to_numpy()]
        length = self.length[place]
        ends = np.cumsum(length)
        ids = self.flat[np.repeat(self.start[place] - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[at - at[0]]
        if not len(slow):
            return ids, bounds
        parts = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        for i in slow:
            parts[i] = np.array(self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


_ENCODERS: dict[tuple, Encoder] = {}
shared.held_by("tokens", _ENCODERS.clear)


def encoder(path: str, keeps_space: bool) -> Encoder:
    """The worker's encoder for a tokenizer file, at the start of a task."""
    shared.begin("tokens")
    if (path, keeps_space) not in _ENCODERS:
        _ENCODERS[path, keeps_space] = Encoder(path, keeps_space)
    return _ENCODERS[path, keeps_space]


def crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
