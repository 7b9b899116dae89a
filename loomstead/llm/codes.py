"""Learned binary codes of vectors, short fixed-point copies of them, and the search inside one cell of an index."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Bits of a code; three substrings of 21 bits, each of which has a table of its own.
BITS, SUBSTRING = 63, 21
TABLES = BITS // SUBSTRING
#: Cells of each table that a vector stands in: its own, and those behind the least certain bits of its prefix.
PROBES = 3
#: In a cell, buckets of at most about so many vectors are compared if their keys differ by at most so many bits.
BUCKET, RADIUS = 1_024, 2
#: Vectors of a cell below which all are compared.
SMALL = 4_096
#: Rows and columns of a block of cosines, and candidates that wait before the best are chosen.
BLOCK, WAITING = 1_024, 1 << 20
#: More candidates than k that are kept until cosines are rounded and ties are decided.
SPARE = 3
_NO_CELL = np.int64(-(1 << 63))
_LEVELS = 2_047


@dataclass(frozen=True)
class Rotation:
    """Centre, rotation, thresholds and spreads that turn vectors into codes with a margin for each bit."""

    centre: np.ndarray
    turn: np.ndarray
    level: np.ndarray
    spread: np.ndarray

    def margins(self, units: np.ndarray) -> np.ndarray:
        """How far each bit is from flipping, in spreads; the bit is the sign."""
        return ((units - self.centre) @ self.turn - self.level) / self.spread

    def bits(self, units: np.ndarray) -> np.ndarray:
        return self.margins(units) > 0


def learn_rotation(units: np.ndarray, rounds: int = 25, seed: int = 11) -> Rotation:
    """Iterative quantisation: principal axes, rotated so that signs lose the least; random axes fill up short vectors.

    units: a sample of unit vectors. Thresholds are the medians, so that each bit halves the sample.
    """
    rng = np.random.default_rng(seed)
    dims = units.shape[1]
    centre = units.mean(0)
    moved = units - centre
    _, axes = np.linalg.eigh(moved.T @ moved)
    axes = axes[:, ::-1][:, : min(dims, BITS)]
    near = moved @ axes
    spin = np.linalg.qr(rng.standard_normal((near.shape[1], near.shape[1])))[0]
    for _ in range(rounds):
        left, _, right = np.linalg.svd(near.T @ np.where(near @ spin > 0, 1.0, -1.0))
        spin = left @ right
    turn = axes @ spin
    if dims < BITS:
        turn = np.hstack([turn, rng.standard_normal((dims, BITS - dims))])
    seen = moved @ turn
    return Rotation(centre, turn, np.median(seen, axis=0), np.maximum(seen.std(axis=0), 1e-12))


@lru_cache(None)
def drawn_rotation(dims: int) -> Rotation:
    """A rotation for models that none is learned for."""
    turn = np.random.default_rng(dims).standard_normal((dims, BITS))
    return Rotation(np.zeros(dims), turn / np.linalg.norm(turn, axis=0), np.zeros(BITS), np.full(BITS, dims**-0.5))


@lru_cache(None)
def bit_order(table: int) -> np.ndarray:
    """The order of bits in a table's key: its substring first."""
    return np.roll(np.arange(BITS), -SUBSTRING * table)


def packed(bits: np.ndarray) -> np.ndarray:
    """Codes as integers below 2**63, the first bit on top."""
    spare = np.zeros((len(bits), 64 - BITS), bool)
    return np.ascontiguousarray(np.packbits(np.hstack([spare, bits]), axis=1)).view(">u8").ravel().astype(np.int64)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    exact = vectors.astype(np.float64)
    # The largest element first, so that squares can't overflow or vanish.
    exact /= np.abs(exact).max(axis=1)[:, None]
    return exact / np.linalg.norm(exact, axis=1)[:, None]


def class_keys(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each direction, rounded to 6 decimals: copies, scaled or not, have the same."""
    steps = np.rint(units * 1e6).astype(np.int64).view(np.uint64)
    rng = np.random.default_rng(units.shape[1])
    out = []
    for _ in range(2):
        odd = rng.integers(0, 1 << 63, units.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        h = (steps * odd).sum(axis=1, dtype=np.uint64)
        h ^= h >> np.uint64(32)
        out.append((h * np.uint64(0x9E3779B97F4A7C15)).view(np.int64))
    return out[0], out[1]


def shortened(units: np.ndarray) -> np.ndarray:
    """Unit vectors in steps of 12 bits: a byte for each element and one for each two; (n, 3/2 of the dimensions)."""
    steps = np.rint(units / np.abs(units).max(axis=1)[:, None] * _LEVELS).astype(np.int16) + (_LEVELS + 1)
    steps = np.pad(steps, ((0, 0), (0, units.shape[1] % 2)), constant_values=_LEVELS + 1)
    high = (steps >> 8).reshape(len(steps), -1, 2) @ np.array([1, 16], np.int16)
    return np.hstack([(steps & 255).astype(np.uint8), high.astype(np.uint8)])


def restored(short: np.ndarray) -> np.ndarray:
    """The unit vectors of shortened(), up to its steps; an even number of dimensions."""
    dims = short.shape[1] // 3 * 2
    high = (short[:, dims:, None] >> np.array([0, 4], np.uint8)) & 15
    out = (high.reshape(len(short), dims).astype(np.int16) << 8 | short[:, :dims]).astype(np.float64) - (_LEVELS + 1)
    return out / np.linalg.norm(out, axis=1)[:, None]


@dataclass(frozen=True)
class Tree:
    """Cells of a table as ranges of codes: where each begins, the bits of its prefix, and the rotation that codes it again or -1."""

    begins: np.ndarray
    bits: np.ndarray
    again: np.ndarray
    again_bits: np.ndarray


@dataclass(frozen=True)
class Index:
    """The tables of one model, and the rotations of the cells whose vectors are too alike for its codes."""

    rotation: Rotation
    trees: tuple[Tree, ...]
    inner: tuple[Rotation, ...] = ()

    def cells(self, units: np.ndarray, salt: int, margins: np.ndarray | None = None) -> np.ndarray:
        """The cells of each vector, (n, slots): its own and probed ones of each table; unused slots are _NO_CELL."""
        deep = PROBES if self.inner else 1
        out = np.full((len(units), TABLES, PROBES, deep), _NO_CELL)
        margins = self.rotation.margins(units) if margins is None else margins
        for t, tree in enumerate(self.trees):
            for p, (code, there) in enumerate(_probed(margins[:, bit_order(t)], lambda c: tree.bits[_leaf(tree, c)])):
                leaf = _leaf(tree, code)
                bits = tree.bits[leaf]
                cell = _cell(salt, t, bits, np.where(bits > 0, code >> np.maximum(BITS - bits, 0), 0))
                out[there, t, p, 0] = cell[there]
                for again in np.unique(tree.again[leaf[there]]):
                    if again < 0:
                        continue
                    rows = np.flatnonzero(there & (tree.again[leaf] == again))
                    wide = int(tree.again_bits[leaf[rows[0]]])
                    below = self.inner[again].margins(units[rows])
                    for q, (inner, fine) in enumerate(_probed(below, lambda c: np.full(len(c), wide))):
                        out[rows, t, p, q] = np.where(fine, _cell(cell[rows], again + 7, wide, inner >> (BITS - wide)), _NO_CELL)
        return out.reshape(len(units), -1)


def _leaf(tree: Tree, code: np.ndarray) -> np.ndarray:
    return np.searchsorted(tree.begins, code, "right") - 1


def _probed(margins: np.ndarray, bits):
    """A code and those that differ in one of its least certain prefix bits, each with the rows that have it."""
    code = packed(margins > 0)
    yield code, np.ones(len(code), bool)
    unsure = np.where(np.arange(BITS) < bits(code)[:, None], np.abs(margins), np.inf)
    flips = np.argpartition(unsure, PROBES - 2, axis=1)[:, : PROBES - 1]
    for p in range(PROBES - 1):
        flip = flips[:, p]
        yield code ^ (np.int64(1) << (BITS - 1 - flip)), np.isfinite(unsure[np.arange(len(code)), flip])


def _cell(salt, table: int, bits, prefix) -> np.ndarray:
    """A cell as one number; cells are told apart by 64 bits."""
    with np.errstate(over="ignore"):
        h = np.asarray(prefix).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(salt).astype(np.int64).view(np.uint64)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + (np.asarray(bits) * 64 + table).astype(np.uint64)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(31))).view(np.int64)


def build_index(sample: np.ndarray, rows: int, cell: int, learned: int = 4_096) -> Index:
    """Learn the codes of a model from a sample of its unit vectors, and split its tables into cells of about `cell` rows.

    Prefixes are split while the sample shows too many rows; one that the sample is too small for gets as many bits
    as its rows need. One that its code's first two substrings don't split is coded again around its own centre.
    """
    rotation = learn_rotation(sample[:learned])
    margins = rotation.margins(sample)
    inner: list[Rotation] = []
    trees = []
    # Each row stands in PROBES cells of a table.
    weight = rows * PROBES / len(sample)
    deepest = 2 * SUBSTRING
    for t in range(TABLES):
        codes = packed(margins[:, bit_order(t)] > 0)
        order = np.argsort(codes, kind="stable")
        ordered = codes[order]
        leaves: list[tuple[int, int, int, int, int]] = []
        todo = [(0, 0, len(ordered))]
        while todo:
            depth, low, high = todo.pop()
            held = (high - low) * weight
            begin = int(ordered[low] >> (BITS - depth) << (BITS - depth)) if depth else 0
            end = begin + (1 << (BITS - depth))
            if held <= cell or high - low < 16 and depth < deepest:
                more = max(0, int(np.ceil(np.log2(max(held, 1) / cell))))
                leaves.append((begin, end, min(depth + more, BITS - 1), -1, 0))
            elif depth >= deepest:
                members = sample[order[low:high]]
                leaves.append((begin, end, depth, len(inner), min(int(np.ceil(np.log2(held * PROBES / cell))), BITS - 1)))
                inner.append(learn_rotation(members[:learned]))
            else:
                bit = np.int64(1) << (BITS - 1 - depth)
                middle = low + int(np.searchsorted(ordered[low:high] & bit, bit))
                todo += [(depth + 1, a, b) for a, b in ((low, middle), (middle, high)) if a < b]
        # A prefix that the sample lacks belongs to the range before it, under a prefix of its own.
        trees.append(Tree(*(np.array(c, np.int64) for c in zip(*_whole(sorted(leaves))))))
    return Index(rotation, tuple(trees), tuple(inner))


def _whole(leaves: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Leaves for all codes: what lies between those of the sample gets leaves of the same depth."""
    out: list[tuple[int, int, int, int]] = []
    at = 0
    for begin, end, bits, again, wide in leaves:
        if begin > at:
            out.append((at, bits, -1, 0))
        out.append((begin, bits, again, wide))
        at = end
    if at < 1 << BITS:
        out.append((at, leaves[-1][2], -1, 0))
    return out


def drawn_index(dims: int, rows: int, cell: int) -> Index:
    """An index without learning: as many prefix bits as the rows need."""
    bits = max(0, int(np.ceil(np.log2(max(rows, 1) * PROBES / cell))))
    one = [np.array([x], np.int64) for x in (0, min(bits, BITS - 1), -1, 0)]
    return Index(drawn_rotation(dims), (Tree(*one),) * TABLES)


class Best:
    """The most similar candidates of each row, while pairs come; at most k of each row and some that wait are held."""

    def __init__(self, rows: int, k: int, least: float):
        self.k, self.least = k, least
        self.other = np.full((rows, k), -1, np.int32)
        self.value = np.full((rows, k), -np.inf, np.float32)
        #: What a candidate must have to count.
        self.bar = np.full(rows, least, np.float32)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.count = 0

    def add(self, rows: np.ndarray, others: np.ndarray, values: np.ndarray) -> None:
        if len(rows):
            self.waiting.append((rows, others, values))
            self.count += len(rows)
        if self.count > WAITING:
            self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        rows, others, values = (np.concatenate(x) for x in zip(*self.waiting))
        self.waiting, self.count = [], 0
        touched, of = np.unique(rows, return_inverse=True)
        held = np.repeat(np.arange(len(touched)), self.k)
        of = np.concatenate([of, held])
        others = np.concatenate([others, self.other[touched].ravel()])
        values = np.concatenate([values, self.value[touched].ravel()])
        # Cosines are within 1, so that one number orders by row, then cosine.
        order = np.argsort(of * 4.0 - values.clip(-1.5, 1.5))
        of, others, values = of[order], others[order], values[order]
        place = np.arange(len(of)) - np.searchsorted(of, np.arange(len(touched)))[of]
        top = place < self.k
        self.other[touched[of[top]], place[top]] = others[top]
        self.value[touched[of[top]], place[top]] = values[top]
        self.bar[touched] = np.maximum(self.value[touched, -1], self.least)


class Cell:
    """The vectors of one cell, each once: copies (of one class and one short form) are the one of the smallest id."""

    def __init__(self, ids: np.ndarray, classes: np.ndarray, short: np.ndarray):
        marks = class_keys(short.astype(np.float64) / 1e6)
        order = np.lexsort((ids, classes, *marks))
        same = np.zeros(len(ids), bool)
        same[1:] = True
        for c in (classes, *marks):
            same[1:] &= c[order][1:] == c[order][:-1]
        kept = order[~same]
        self.ids, self.units = ids[kept], restored(short[kept])

    def blocks(self, bits: np.ndarray | None) -> list[tuple[np.ndarray, int]]:
        """Rows in blocks, with the key that a block's rows share."""
        n = len(self.ids)
        wide = int((n - 1) // BUCKET).bit_length() if bits is not None and n > SMALL else 0
        if not wide:
            return [(np.arange(s, min(s + BLOCK, n)), 0) for s in range(0, n, BLOCK)]
        # The bits that split this cell best.
        chosen = np.argsort(np.abs(bits.mean(axis=0) - 0.5), kind="stable")[:wide]
        key = bits[:, chosen] @ (1 << np.arange(wide))
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        parts = np.split(order, cuts)
        return [(p[s : s + BLOCK], int(key[p[0]])) for p in parts for s in range(0, len(p), BLOCK)]

    def best(self, k: int, least: float, bits: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row the k most similar of the probed rows with at least that cosine: rows, rows of those, cosines.

        bits: codes of the rows, by which a large cell is probed; null compares all.
        """
        blocks = self.blocks(bits)
        # Rows in the order of their blocks, so that a block is a slice.
        order = np.concatenate([rows for rows, _ in blocks])
        narrow = self.units[order].astype(np.float32)
        ends = np.cumsum([len(rows) for rows, _ in blocks]).tolist()
        spans = [(end - len(rows), end, key) for (rows, key), end in zip(blocks, ends)]
        found = Best(len(self.ids), k + SPARE, least - 1e-5)
        for n, (x, x_end, mine) in enumerate(spans):
            for y, y_end, theirs in spans[n:]:
                if (mine ^ theirs).bit_count() <= RADIUS:
                    _compare(narrow, slice(x, x_end), slice(y, y_end), found)
        found.settle()
        a = np.repeat(np.arange(len(self.ids)), k + SPARE)
        b = found.other.ravel()
        a, b = order[a[b >= 0]], order[b[b >= 0]]
        cosine = np.round(np.einsum("nd,nd->n", self.units[a], self.units[b]), 6)
        a, b, cosine = a[cosine >= least], b[cosine >= least], cosine[cosine >= least]
        order = np.lexsort((self.ids[b], -cosine, a))
        a, b, cosine = a[order], b[order], cosine[order]
        top = np.arange(len(a)) - np.searchsorted(a, a) < k
        return a[top], b[top], cosine[top]


def _compare(narrow: np.ndarray, x: slice, y: slice, found: Best) -> None:
    """All pairs of two blocks (or of one) that reach a row's bar."""
    cosines = narrow[x] @ narrow[y].T
    own = x == y
    if own:
        np.fill_diagonal(cosines, -2.0)
    wide = cosines.shape[1]
    # While no row is full, one look serves both sides.
    open_ = found.bar[x].max() <= found.least and found.bar[y].max() <= found.least
    for side in (0,) if open_ or own else (0, 1):
        bar = found.least if open_ else found.bar[y] if side else found.bar[x][:, None]
        at = np.flatnonzero((cosines >= bar).ravel())
        if len(at) > 32 * sum(cosines.shape) and min(cosines.shape) > found.k:
            # Rows with many: the best of each first, so that no more than these wait.
            sides = ((x, y, cosines), (y, x, cosines.T))
            for one, two, values in sides[:1] if own else sides if open_ else sides[side : side + 1]:
                near = np.argpartition(-values, found.k - 1, axis=1)[:, : found.k]
                best = np.take_along_axis(values, near, 1)
                i, j = np.nonzero(best >= found.bar[one][:, None])
                found.add(one.start + i, two.start + near[i, j], best[i, j])
            found.settle()
        elif len(at):
            i, j = x.start + at // wide, y.start + at % wide
            value = cosines.ravel()[at]
            if not side:
                found.add(i, j, value)
            if side or open_ and not own:
                found.add(j, i, value)


def meets_first(mine: np.ndarray, theirs: np.ndarray, here: int) -> np.ndarray:
    """Whether, of the cells that both vectors of a pair stand in, this one has the least number."""
    out = np.ones(len(mine), bool)
    for s in range(0, len(mine), 50_000):
        a, b = mine[s : s + 50_000], theirs[s : s + 50_000]
        lower = (a < here) & (a != _NO_CELL)
        both = (a[:, :, None] == b[:, None, :]) & lower[:, :, None]
        out[s : s + 50_000] = ~both.any(axis=(1, 2))
    return out
