"""Sets of word sequences, their one-bit sketches, and bit-sliced comparison of sketches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from noctiluca.llm.words import WordIds, mixed, rolling, words

BITS = 256


def sequence_sets(texts: list[str], n: int, known: WordIds) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, starts): the distinct n-word sequences of each text as sorted 64-bit hashes, one text after another."""
    split = [words(t) for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    h = rolling(known.of([w for ws in split for w in ws]), n)
    if not len(h):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    whole = np.flatnonzero(owner[: len(h)] == owner[n - 1 :])
    h, owner = h[whole], owner[whole]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    first = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])] if len(h) else np.empty(0, bool)
    h, owner = h[first], owner[first]
    return h, np.r_[0, np.cumsum(np.bincount(owner, minlength=len(texts)))].astype(np.int64)


def set_keys(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set: equal sets have equal keys (sum and xor of the members, mixed)."""
    if not len(tokens):
        return np.zeros(len(starts) - 1, np.uint64)
    at = np.minimum(starts[:-1], len(tokens) - 1)
    empty = starts[1:] == starts[:-1]
    total, parity = np.add.reduceat(mixed(tokens), at), np.bitwise_xor.reduceat(mixed(tokens + np.uint64(1)), at)
    return np.where(empty, np.uint64(0), mixed(total ^ mixed(parity)))


def minima(tokens: np.ndarray, starts: np.ndarray, count: int, seed: int = 17) -> np.ndarray:
    """(sets, count): minimum of each of ``count`` multiplicative hashes over each non-empty set."""
    factors = np.random.default_rng(seed).integers(0, 2**63, count, np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((count, len(starts) - 1), np.uint64)
    for k in range(count):
        out[k] = np.minimum.reduceat(tokens * factors[k], starts[:-1])
    return np.ascontiguousarray(out.T)


def one_bit_sketches(m: np.ndarray) -> np.ndarray:
    """(sets, BITS / 64) words holding one bit of each of BITS minima. Two sets of likeness J differ in BITS (1 - J) / 2 bits."""
    bits = ((mixed(m[:, :BITS]) >> np.uint64(7)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def band_tokens(m: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(sets, bands): one hash per band of ``rows`` minima."""
    h = np.zeros((len(m), bands), np.uint64) + np.arange(bands, dtype=np.uint64)
    for r in range(rows):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + m[:, r : bands * rows : rows])
    return h


def radius(likeness: float, deviations: float = 4.2) -> int:
    """The distance that sketches of sets with at least this likeness exceed with a probability of about 1e-5."""
    p = (1 - likeness) / 2
    return int(np.ceil(BITS * p + deviations * np.sqrt(BITS * p * (1 - p))))


class SlicedCounter:
    """Counts set bits per lane over many planes. A plane is an array of words, one lane per bit. Planes of equal weight
    wait until there are three, which a carry-save adder turns into one of that weight and one of the next."""

    def __init__(self) -> None:
        self.waiting: list[list[np.ndarray]] = []

    def add(self, plane: np.ndarray, weight: int = 0) -> None:
        while len(self.waiting) <= weight:
            self.waiting.append([])
        here = self.waiting[weight]
        here.append(plane)
        if len(here) == 3:
            a, b, c = here
            either = a ^ b
            here[:] = [either ^ c]
            self.add((a & b) | (c & either), weight + 1)

    def exceeds(self, limit: int) -> np.ndarray:
        """Mask of the lanes whose count so far is above ``limit``."""
        zero = np.zeros_like(next(p for w in self.waiting for p in w))
        digits, carry = [], zero
        for here in [*self.waiting, [], []]:
            a, b = [*here, zero, zero][:2]
            digits.append(a ^ b ^ carry)
            carry = (a & b) | (carry & (a ^ b))
        above, equal = zero, ~zero
        for k in reversed(range(len(digits))):
            if limit >> k & 1:
                equal = equal & digits[k]
            else:
                above = above | (equal & digits[k])
                equal = equal & ~digits[k]
        return above

    def keep(self, at: np.ndarray) -> None:
        self.waiting = [[p[at] for p in here] for here in self.waiting]


def planes_of(sketches: np.ndarray) -> np.ndarray:
    """(BITS, words): the sketches stored vertically, bit plane by bit plane, a lane per sketch. Eight lanes' bytes make a
    word, whose 8 x 8 bits are transposed by three masked exchanges."""
    lanes = -(-len(sketches) // 64) * 64
    flat = np.zeros((BITS // 8, lanes), np.uint8)
    flat[:, : len(sketches)] = np.ascontiguousarray(sketches).view(np.uint8).T
    x = flat.view(np.uint64)
    for shift, mask in ((7, 0x00AA00AA00AA00AA), (14, 0x0000CCCC0000CCCC), (28, 0x00000000F0F0F0F0)):
        t = (x ^ (x >> np.uint64(shift))) & np.uint64(mask)
        x = x ^ t ^ (t << np.uint64(shift))
    return np.ascontiguousarray(x.view(np.uint8).reshape(BITS // 8, lanes // 8, 8).transpose(0, 2, 1)).reshape(BITS, lanes // 8).view(np.uint64)


def lanes_within(planes: np.ndarray, limit: int, lanes: int, step: int = 64) -> np.ndarray:
    """Mask of the lanes with at most ``limit`` set bits over all planes. After every ``step`` planes the blocks of 64
    lanes that all exceed the limit are abandoned."""
    words_left = np.arange(planes.shape[1])
    counter = SlicedCounter()
    for first in range(0, len(planes), step):
        part = planes[first : first + step] if len(words_left) == planes.shape[1] else planes[first : first + step, words_left]
        for plane in part:
            counter.add(plane)
        if first + step < len(planes) and first + step > limit:
            alive = np.flatnonzero(counter.exceeds(limit) != np.uint64(0xFFFFFFFFFFFFFFFF))
            if len(alive) < len(words_left):
                words_left = words_left[alive]
                counter.keep(alive)
                if not len(words_left):
                    break
    out = np.zeros(planes.shape[1], np.uint64)
    if len(words_left):
        out[words_left] = ~counter.exceeds(limit)
    return np.unpackbits(out.view(np.uint8), bitorder="little")[:lanes].astype(bool)


class Forest:
    """Union-find over 0 .. n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


class Run:
    """The sketches of one crowded run of rows, stored vertically. Rows that were reached leave it."""

    def __init__(self, rows: np.ndarray, sketch: np.ndarray):
        self.rows, self.sketch = rows, sketch
        self.alive = np.ones(len(rows), bool)
        self.planes = planes_of(sketch[rows])

    def near(self, x: int, limit: int) -> np.ndarray:
        """Places of the rows still here whose sketch is within the limit of row x's."""
        bits = np.unpackbits(np.ascontiguousarray(self.sketch[x]).view(np.uint8), bitorder="little").astype(np.uint64)
        return np.flatnonzero(lanes_within(self.planes ^ (np.uint64(0) - bits)[:, None], limit, len(self.rows)) & self.alive)

    def leave(self, places: np.ndarray) -> None:
        self.alive[places] = False
        if self.alive.sum() * 2 < len(self.rows):
            self.rows = self.rows[self.alive]
            self.alive = np.ones(len(self.rows), bool)
            self.planes = planes_of(self.sketch[self.rows])


def near_in_block(token: np.ndarray, row: np.ndarray, size: np.ndarray, sketch: np.ndarray, likeness: float, side: np.ndarray | None = None, crowded: int = 128) -> Iterator[tuple[int, int]]:
    """Pairs of rows that connect everything which shares a token and whose sketches are within the radius.

    ``token`` and ``row`` are postings; with ``side`` (0 or 1 per row) only pairs of different sides count. Runs of one
    token are compared pair by pair in lanes. A crowded run is searched breadth-first: a row is compared at once with the
    bit planes of all rows not reached yet, those within the radius leave the planes and are searched from in turn, so a
    run of near copies costs little more than one pass; once a search reaches few, what is left of a run that isn't too
    long is compared pair by pair. Yields fewer pairs than there are rows."""
    order = np.lexsort((row, token))
    token, row = token[order], row[order]
    first = np.r_[True, (token[1:] != token[:-1]) | (row[1:] != row[:-1])] if len(token) else np.empty(0, bool)
    token, row = token[first], row[first]
    begin = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.empty(0, int)
    length = np.diff(np.r_[begin, len(token)])
    limit, n = radius(likeness), len(size)
    forest = Forest(n)
    keys: list[np.ndarray] = []

    def fits(a: np.ndarray | int, b: np.ndarray) -> np.ndarray:
        small, large = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
        ok = small >= likeness * large - 1e-9
        return ok if side is None else ok & (side[a] != side[b])

    def flush() -> Iterator[tuple[int, int]]:
        if not keys:
            return
        unique = np.unique(np.concatenate(keys))
        keys.clear()
        for at in range(0, len(unique), 32_768):
            a, b = np.divmod(unique[at : at + 32_768], n)
            near = lanes_within(planes_of(sketch[a] ^ sketch[b]), limit, len(a))
            for x, y in zip(a[near].tolist(), b[near].tolist(), strict=True):
                if forest.join(x, y):
                    yield x, y

    ends = np.repeat(begin + length, length)
    at = np.flatnonzero(np.repeat((length > 1) & (length <= crowded), length))
    gap, held = 1, 0
    while len(at := at[at + gap < ends[at]]):
        for part in range(0, len(at), 2_000_000):
            a, b = row[at[part : part + 2_000_000]], row[at[part : part + 2_000_000] + gap]
            ok = fits(a, b)
            keys.append(np.minimum(a, b)[ok].astype(np.int64) * n + np.maximum(a, b)[ok])
            held += int(ok.sum())
            if held > 4_000_000:
                yield from flush()
                held = 0
        gap += 1
    yield from flush()
    for k in np.flatnonzero(length > crowded):
        run = Run(row[begin[k] : begin[k] + length[k]], sketch)
        while (left := np.flatnonzero(run.alive)).size:
            start, before = int(left[0]), left.size
            frontier = [int(run.rows[start])]
            run.leave(np.array([start]))
            while frontier and run.alive.any():
                x = frontier.pop()
                places = run.near(x, limit)
                places = places[fits(x, run.rows[places])]
                reached = run.rows[places].tolist()
                if reached:
                    run.leave(places)
                    frontier += reached
                    for y in reached:
                        if forest.join(x, y):
                            yield x, y
            left = run.rows[run.alive]
            if len(left) <= 32 * crowded and before - len(left) < before / 16:
                a, b = np.triu_indices(len(left), 1)
                ok = fits(left[a], left[b])
                keys.append(np.minimum(left[a], left[b])[ok].astype(np.int64) * n + np.maximum(left[a], left[b])[ok])
                yield from flush()
                break
