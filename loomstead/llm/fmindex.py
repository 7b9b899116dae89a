"""A compressed full-text index of many short texts, searched backward for many patterns at once.

The index holds the Burrows-Wheeler transform of the texts (each closed by its own mark) in a wavelet tree of
Huffman shape, so that a text of entropy H takes about H bits a character and a rank takes about H steps.
All steps work on arrays: one step of the search moves every pattern by one character.
"""

from __future__ import annotations

import heapq

import numpy as np


class RankBits:
    """Bits with the number of ones before each place."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


def code_words(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Canonical prefix code words of symbols by their counts (Huffman): the words and their lengths."""
    n = len(counts)
    lengths = np.ones(n, np.int64)
    if n > 1:
        heap = [(int(c), i, (i,)) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        lengths[:] = 0
        tick = n
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for i in (*a[2], *b[2]):
                lengths[i] += 1
            heapq.heappush(heap, (a[0] + b[0], tick, a[2] + b[2]))
            tick += 1
    words, word, last = np.zeros(n, np.int64), 0, 0
    for i in np.lexsort((np.arange(n), lengths)):
        word <<= int(lengths[i]) - last
        last = int(lengths[i])
        words[i] = word
        word += 1
    return words, lengths


class WaveletTree:
    """Rank of any symbol in a sequence, in as many steps as its code word has bits."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        counts = np.bincount(sequence, minlength=symbols)
        self.words, self.lengths = code_words(np.maximum(counts, 1))
        self.levels: list[RankBits] = []
        self.node: list[np.ndarray] = []  # where each symbol's node begins on a level
        self.ones: list[np.ndarray] = []  # ones before that
        self.bit: list[np.ndarray] = []
        for level in range(int(self.lengths.max())):
            deep = self.lengths > level
            prefix = np.where(deep, self.words >> np.maximum(self.lengths - level, 0), 0)
            sequence = sequence[deep[sequence]]
            order = np.argsort(prefix[sequence], kind="stable")
            sequence = sequence[order]
            bit = np.where(deep, (self.words >> np.maximum(self.lengths - level - 1, 0)) & 1, 0).astype(np.uint8)
            bits = RankBits(bit[sequence])
            begin = np.searchsorted(prefix[sequence], prefix)
            self.levels.append(bits)
            self.node.append(begin)
            self.ones.append(bits.rank(begin))
            self.bit.append(bit.astype(bool))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        out = at.copy()
        lengths = self.lengths[symbol]
        shortest, longest = int(lengths.min()), int(lengths.max())
        live = None
        for level in range(longest):
            if level >= shortest:
                live = np.flatnonzero(lengths > level)
            s = symbol if live is None else symbol[live]
            i = out if live is None else out[live]
            ones = self.levels[level].rank(self.node[level][s] + i) - self.ones[level][s]
            i = np.where(self.bit[level][s], ones, i - ones)
            if live is None:
                out = i
            else:
                out[live] = i
        return out


class SharedTextIndex:
    """Index of texts, each belonging to one owner or to several, for finding what stands with another owner too.

    low, high: the least and the greatest owner of each text; equal if it has one.
    """

    def __init__(self, texts: list[str], low: np.ndarray, high: np.ndarray):
        sizes = np.array([len(t) for t in texts], np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        alphabet, dense = np.unique(points, return_inverse=True)
        count = len(texts)
        self.n = n = len(points) + count
        self.ends = np.cumsum(sizes + 1) - 1
        self.begins = self.ends - sizes
        marks = np.zeros(n, bool)
        marks[self.ends] = True
        self.symbols = np.zeros(n, np.int64)
        self.symbols[~marks] = dense + 1
        # While sorting each mark is a symbol of its own, so that no two suffixes are equal.
        unique = self.symbols + (count - 1)
        unique[self.ends] = np.arange(count)
        order, levels, unit = _suffix_order(unique, count + len(alphabet), int(sizes.max(initial=0)) + 1)
        self.lcp = _common_prefixes(unique, order, levels, unit)
        transform = self.symbols[order - 1]
        self.tree = WaveletTree(transform, len(alphabet) + 1)
        totals = np.bincount(transform, minlength=len(alphabet) + 1)
        self.first = np.cumsum(totals) - totals
        self.smaller_before, self.smaller_after = _smaller_values(self.lcp)
        text_of = np.repeat(np.arange(count), sizes + 1)[order]
        owner = low[text_of]
        several = (low != high)[text_of]
        differs = np.ones(n + 1, bool)
        differs[1:n] = (owner[1:] != owner[:-1]) | several[1:] | several[:-1]
        places = np.where(differs, np.arange(n + 1), n)
        following = np.minimum.accumulate(places[::-1])[::-1]
        self.same_until = np.where(several, np.arange(n), following[1:])

    def spans(self, need: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of every text against all owners but its own: all maximal spans of at least `need`, and some within them.

        Returns the number of the text, begin and end of each span. A pattern is read from its end. It is extended
        to the left while what is read also stands with another owner; else its end is moved left to the next
        shorter match with more places (the parent interval), until it can be extended or is empty.
        """
        live = np.flatnonzero(self.ends - self.begins >= need)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        begin, at = self.begins[live], self.ends[live] - 1
        low, high = np.zeros(len(live), np.int64), np.full(len(live), self.n)
        depth = np.zeros(len(live), np.int64)

        def note(which: np.ndarray) -> None:
            which = which & (depth >= need)
            if which.any():
                start = at[which] + 1 - begin[which]
                found.append((live[which], start, start + depth[which]))

        while len(live):
            symbol = self.symbols[at]
            both = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
            base = self.first[symbol]
            new_low, new_high = base + both[: len(live)], base + both[len(live) :]
            good = new_low < new_high
            good &= self.same_until[np.where(good, new_low, 0)] < new_high
            note(~good)
            up = np.maximum(self.lcp[low], self.lcp[high])
            wider_low = np.where(self.lcp[low] == up, self.smaller_before[low], low)
            wider_high = np.where(self.lcp[high] == up, self.smaller_after[high], high)
            top = up == 0
            empty = ~good & (depth == 0)
            low = np.where(good, new_low, np.where(top, 0, wider_low))
            high = np.where(good, new_high, np.where(top, self.n, wider_high))
            depth = np.where(good, depth + 1, up)
            at = at - (good | empty)
            # A span that would end before `need` can't be long enough any more.
            over = at < begin
            note(over & good)
            keep = ~over & (at + 1 + depth - begin >= need)
            if not keep.all():
                live, begin, at, low, high, depth = (x[keep] for x in (live, begin, at, low, high, depth))
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none
        return tuple(np.concatenate(x) for x in zip(*found))


def _suffix_order(symbols: np.ndarray, kinds: int, longest: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]], int]:
    """Suffixes in order, by doubling; the ranks at each length on the way; the first length."""
    n = len(symbols)
    unit = max(1, min(63 // max(1, int(kinds).bit_length()), longest))
    shift = int(kinds).bit_length()
    padded = np.concatenate([symbols, np.zeros(unit, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(unit):
        key = key << shift | padded[k : k + n]
    levels: list[tuple[int, np.ndarray]] = []
    depth = unit
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.int32)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        levels.append((depth, rank))
        if depth >= longest or rank[order[-1]] == n - 1:
            return order, levels, unit
        key = rank.astype(np.int64) * (n + 1)
        key[: n - depth] += rank[depth:] + 1
        depth *= 2


def _common_prefixes(symbols: np.ndarray, order: np.ndarray, levels: list[tuple[int, np.ndarray]], unit: int) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before in order; 0 at both ends."""
    n = len(symbols)
    a, b = order[:-1].astype(np.int32), order[1:].astype(np.int32)
    common = np.zeros(n - 1, np.int32)
    for depth, rank in reversed(levels):
        # Marks keep suffixes apart, so that neither place can pass the end while both agree.
        step = (rank[a] == rank[b]) * np.int32(depth)
        a += step
        b += step
        np.minimum(a, n - 1, out=a)
        np.minimum(b, n - 1, out=b)
        common += step
    todo = np.arange(n - 1)
    for _ in range(unit):
        todo = todo[np.maximum(a[todo], b[todo]) < n]
        todo = todo[symbols[a[todo]] == symbols[b[todo]]]
        a[todo] += 1
        b[todo] += 1
        common[todo] += 1
    return np.concatenate([[0], common, [0]])


def _smaller_values(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the nearest place before, and after, with a smaller value; the ends count as smaller."""
    last = len(values) - 1

    def nearest(v: np.ndarray) -> np.ndarray:
        to = np.arange(len(v)) - 1
        to[0] = 0
        todo = np.arange(1, len(v))
        while len(todo):
            todo = todo[(to[todo] > 0) & (v[to[todo]] >= v[todo])]
            to[todo] = to[to[todo]]
        return to

    return nearest(values), last - nearest(values[::-1])[::1][::-1]
