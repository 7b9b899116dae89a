"""Exact byte-pair encoding in linear time, by an automaton over the vocabulary and backtracking.

The merges of a vocabulary define one encoding of each piece of text. A sequence of tokens is that encoding
if and only if each two neighbours, taken alone, would not merge into anything else ("compatible"). So the
encoder walks over a piece with the longest token at each place, found in the trie of an Aho-Corasick
automaton, accepts a token if it is compatible with the one before, goes to its next shorter prefix if not,
and steps back over a token when no prefix is left. A bit for each place keeps dead ends from being tried
twice, so each place is visited a bounded number of times.

Bytes are mapped to the characters of Latin-1, which is what the automaton reads.
"""

from __future__ import annotations

import json
import os
from array import array

import ahocorasick
import numpy as np
import regex

#: Where the vocabulary files are, unless a path is given.
TOKENIZER_DIR = os.environ.get("LOOMSTEAD_TOKENIZERS", "/opt/tokenizers")
#: The pattern that splits text into pieces before the merges (that of the vocabulary's README).
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct pieces kept with their ids in a worker; beyond that the memo starts anew.
MEMO_PIECES = 400_000
_BIG = 1 << 17  # above all token numbers


def vocabulary_path(name: str, folder: str | None = None) -> str:
    return os.path.join(folder or TOKENIZER_DIR, f"{name}.json")


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    alphabet = {chr(b): b for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in set(plain)):
        alphabet[chr(256 + i)] = b
    return alphabet


class BytePairEncoder:
    """Encodes texts by one byte-level vocabulary file; special tokens are ordinary text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        alphabet = _byte_alphabet()
        spell = {t: "".join(chr(alphabet[c]) for c in t) for t in model["vocab"] if all(c in alphabet for c in t)}
        ids = {spell[t]: i for t, i in model["vocab"].items() if t in spell}
        # Tokens are numbered by the rank of the merge that makes them; bytes come first.
        order: list[str] = [chr(b) for b in range(256)]
        rank = {t: i for i, t in enumerate(order)}
        self._left, self._right = list(range(256)), list(range(256))
        self._merged: dict[int, int] = {}
        for merge in model["merges"]:
            a, b = (spell[x] for x in (merge if isinstance(merge, list) else merge.split(" ")))
            whole = a + b
            if whole not in ids:
                continue
            if whole not in rank:
                rank[whole] = len(order)
                order.append(whole)
                self._left.append(rank[a])
                self._right.append(rank[b])
            self._merged.setdefault(rank[a] << 17 | rank[b], rank[whole])
        self._id = [ids[t] for t in order]
        self._length = [len(t) for t in order]
        self._shorter = [-1] * len(order)
        for t, i in rank.items():
            for n in range(len(t) - 1, 0, -1):
                if (j := rank.get(t[:n])) is not None:
                    self._shorter[i] = j
                    break
        self._widest = max(self._length)
        self._automaton = ahocorasick.Automaton()
        for t, i in rank.items():
            self._automaton.add_word(t, i)
        self._automaton.make_automaton()
        self._rank = rank
        self._compatible: dict[int, bool] = {}
        self._forget()

    def _learn(self, a: int, b: int) -> bool:
        """Whether the merges of the two tokens' text end in just these two tokens; kept for the next time."""
        if len(self._compatible) > 3_000_000:
            self._compatible.clear()
        fits = self._compatible[a << 17 | b] = self._unmerged(a, b)
        return fits

    def _unmerged(self, a: int, b: int) -> bool:
        """Undo the latest merge on either side of the seam, and look each time for an earlier merge across it."""
        before = _BIG
        while True:
            across = self._merged.get(a << 17 | b)
            if across is not None and across < before:
                return False
            if a > b:
                if a < 256:
                    return True
                before, a = a, self._right[a]
            else:
                if b < 256:
                    if a < 256:
                        return True
                    before, a = a, self._right[a]
                    continue
                before, b = b + 1, self._left[b]

    def piece(self, s: str) -> list[int]:
        """The ids of one piece, given as Latin-1 (no splitting)."""
        whole = self._rank.get(s)
        if whole is not None:
            return [self._id[whole]]
        # The automaton's trie walks from each place as far as any token goes; hot calls are bound to local names.
        n, widest, rank = len(s), self._widest, self._rank
        lengths, known, shorter, walk = self._length, self._compatible.get, self._shorter, self._automaton.longest_prefix
        dead: set[int] = set()
        out: list[int] = []
        last, at, token = -1, 0, None
        while True:
            if token is None:
                rest = s[at : at + widest] if at or n > widest else s
                k = walk(rest)
                token = rank.get(rest[:k])
                while token is None:
                    k -= 1
                    token = rank.get(rest[:k])
            end = at + lengths[token]
            if end not in dead:
                fits = last < 0 or known(last << 17 | token)
                if fits is None:
                    fits = self._learn(last, token)
                if fits:
                    out.append(token)
                    if end == n:
                        break
                    last, at, token = token, end, None
                    continue
            token = shorter[token]
            while token < 0:
                dead.add(at)
                token = out.pop()
                at -= lengths[token]
                token = shorter[token]
                last = out[-1] if out else -1
        ids = self._id
        return [ids[t] for t in out]

    def encode(self, text: str) -> list[int]:
        """The ids of a text; [] for the empty one."""
        flat, ends = self.encode_batch([text])
        return flat.tolist()

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's end.

        Pieces are found for all texts at once; each distinct piece is encoded once. Pieces of up to 32 bytes are
        told apart by their bytes packed into four words, hashed and compared with the first of their hash, so
        that a clash of hashes is noticed and such a batch goes the plain way.
        """
        data, starts, sizes, owner_ends = split_batch(texts)
        ids, offsets = self._ids, self._offsets
        slots = np.empty(len(starts), np.int64)
        short = sizes <= 32
        where = np.flatnonzero(short)
        if len(where):
            words = _packed(data, starts[where], sizes[where])
            mixed = words[0].copy()
            for w in words[1:]:
                mixed *= _ODD
                mixed ^= mixed >> _HALF
                mixed += w
            mixed = mixed * _ODD + sizes[where].astype(np.uint64)
            _, first, back = np.unique(mixed, return_index=True, return_inverse=True)
            sample = first[back]
            clash = any((w[sample] != w).any() for w in words) or (sizes[where][sample] != sizes[where]).any()
            if clash:
                slots[where] = [self._slot(data[a : a + n].tobytes()) for a, n in zip(starts[where], sizes[where])]
            else:
                known = [self._slot(data[a : a + n].tobytes()) for a, n in zip(starts[where][first], sizes[where][first])]
                slots[where] = np.array(known, np.int64)[back]
        for i in np.flatnonzero(~short):
            slots[i] = self._slot(data[starts[i] : starts[i] + sizes[i]].tobytes())
        table = np.frombuffer(ids, np.int32)
        begin = np.frombuffer(offsets, np.int64)
        lengths = begin[slots + 1] - begin[slots]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        flat = table[np.repeat(begin[slots] - (ends - lengths), lengths) + np.arange(total)]
        upto = np.concatenate([[0], ends])[owner_ends]
        del table, begin  # else the memo's arrays couldn't grow
        if len(self._memo) > MEMO_PIECES:
            self._forget()
        return flat, upto

    def _slot(self, piece: bytes) -> int:
        slot = self._memo.get(piece)
        if slot is None:
            slot = self._memo[piece] = len(self._offsets) - 1
            self._ids.extend(self.piece(piece.decode("latin-1")))
            self._offsets.append(len(self._ids))
        return slot

    def _forget(self) -> None:
        self._memo: dict[bytes, int] = {}
        self._ids = array("i")
        self._offsets = array("q", [0])


def _kinds() -> np.ndarray:
    """The kind of each code point: letter 0, number 1, white space 2, other 3 (the classes of PIECES)."""
    every = "".join(map(chr, range(0x110000)))
    kinds = np.full(0x110000, 3, np.uint8)
    for kind, pattern in ((0, r"\p{L}"), (1, r"\p{N}"), (2, r"\s")):
        for m in regex.finditer(pattern + "+", every):
            kinds[m.start() : m.end()] = kind
    kinds[0x1C:0x20] = 3  # no white space to the vocabulary's own pattern
    return kinds


_kind_table: list[np.ndarray] = []


def split_batch(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cut texts into the pieces of PIECES: their bytes, each piece's start and size, and each text's end among the pieces.

    A run of letters, numbers or other characters is a piece, with one blank before it; of longer white space the
    last character stands alone (or joins, if a blank), and the rest is a piece; an English contraction is a piece
    where its apostrophe begins one.
    """
    if not _kind_table:
        _kind_table.append(_kinds())
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    data = np.frombuffer(joined.encode("utf-8", "surrogatepass") + bytes(32), np.uint8)
    n = len(points)
    text_ends = np.cumsum([len(t) for t in texts]) if texts else np.zeros(0, np.int64)
    if not n:
        return data, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    kind = _kind_table[0][points]
    opens = np.zeros(n + 1, bool)
    opens[0] = True
    opens[text_ends] = True  # text starts; the last one closes
    run = opens.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    start = run[:n].copy()
    space = kind == 2
    # The last white space before something else in the same text begins a piece; a blank takes what follows along.
    last = np.zeros(n, bool)
    last[: n - 1] = space[:-1] & ~space[1:] & ~opens[1:n]
    start |= last
    joins = np.flatnonzero(last & (points == 32))
    start[joins + 1] = False
    quote = np.flatnonzero((points == 39) & start)
    if len(quote):
        limit = np.searchsorted(text_ends, quote, side="right")
        room = text_ends[limit] - quote
        after = np.concatenate([points, np.zeros(2, np.uint32)])
        one, two = after[quote + 1], after[quote + 2]
        short = (room >= 2) & np.isin(one, [ord(c) for c in "stmd"])
        long = (room >= 3) & (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108))
        for which, width in ((short, 2), (long, 3)):
            q = quote[which]
            start[q + 1] = False
            if width == 3:
                start[q + 2] = False
            beyond = q + width
            start[beyond[beyond < n]] = True
    wide = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
    at = np.concatenate([[0], np.cumsum(wide, dtype=np.int64)])
    first = np.flatnonzero(start)
    starts = at[first]
    sizes = np.diff(np.append(starts, at[n]))
    return data, starts, sizes, np.searchsorted(first, text_ends)


def _packed(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """The first 32 bytes from each start as four words, with zeros beyond the size."""
    view = np.lib.stride_tricks.as_strided(data.view(), shape=(len(data) - 7,), strides=(1,))
    wide = np.ndarray((len(view),), np.dtype("<u8"), buffer=data, strides=(1,))
    words = []
    for k in range(4):
        keep = np.clip(sizes - 8 * k, 0, 8)
        word = wide[np.where(keep > 0, starts + 8 * k, 0)]
        words.append(np.where(keep > 0, word & _MASKS[keep], np.uint64(0)))
    return words


_ODD, _HALF = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

_encoders: dict[str, BytePairEncoder] = {}


def encoder(path: str) -> BytePairEncoder:
    """The encoder of a vocabulary file, built once in each Python worker."""
    if path not in _encoders:
        _encoders[path] = BytePairEncoder(path)
    return _encoders[path]
