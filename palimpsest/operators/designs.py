"""Sample designs that any task can make from a row's number: Sobol' points, Saltelli's matrices, row resamples.

Nothing here holds a whole design: ``sobol_points`` gives rows ``first`` to ``first + n`` of one endless sequence, so a larger
sample keeps all rows of a smaller one, and tasks need no more than numbers to agree.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BITS = 32
_MASK = np.uint64(0xFFFFFFFF)


def _primitive(polynomial: int, degree: int) -> bool:
    """Whether x generates all 2**degree - 1 nonzero residues modulo a polynomial over GF(2)."""
    order = (1 << degree) - 1
    primes = [p for p in range(2, order + 1) if order % p == 0 and all(p % q for q in range(2, int(p**0.5) + 1))]

    def power(e: int) -> int:
        out, base = 1, 2 if degree > 1 else 1
        while e:
            if e & 1:
                out = _product(out, base, polynomial, degree)
            base = _product(base, base, polynomial, degree)
            e >>= 1
        return out

    return power(order) == 1 and all(power(order // p) != 1 for p in primes)


def _product(a: int, b: int, polynomial: int, degree: int) -> int:
    out = 0
    while b:
        if b & 1:
            out ^= a
        a <<= 1
        if a >> degree:
            a ^= polynomial
        b >>= 1
    return out


@lru_cache
def direction_numbers(dimensions: int) -> np.ndarray:
    """(dimensions, 32) direction numbers: bit k of a row's number adds number k of each dimension.

    The first dimension reverses the bits; each other one takes the next primitive polynomial by degree, and starts with odd numbers
    drawn from a fixed seed, so that every power-of-two block has one point in each of its intervals.
    """
    out = np.zeros((dimensions, BITS), np.uint64)
    out[0] = [1 << (BITS - 1 - k) for k in range(BITS)]
    rng = np.random.default_rng(20240131)
    found, degree = 1, 0
    while found < dimensions:
        degree += 1
        for inner in range(1 << (degree - 1)):
            polynomial = (1 << degree) | (inner << 1) | 1
            if found == dimensions or not _primitive(polynomial, degree):
                continue
            m = [int(rng.integers(0, 1 << k)) * 2 + 1 for k in range(degree)]
            for k in range(degree, BITS):
                new = m[k - degree] ^ (m[k - degree] << degree)
                for j in range(1, degree):
                    if polynomial >> (degree - j) & 1:
                        new ^= m[k - j] << j
                m.append(new)
            out[found] = [m[k] << (BITS - 1 - k) for k in range(BITS)]
            found += 1
    return out


def _reversed_bits(x: np.ndarray) -> np.ndarray:
    for shift, mask in ((1, 0x55555555), (2, 0x33333333), (4, 0x0F0F0F0F), (8, 0x00FF00FF), (16, 0x0000FFFF)):
        m = np.uint64(mask)
        x = ((x >> np.uint64(shift)) & m) | ((x & m) << np.uint64(shift))
    return x


#: Even multipliers: a bit then changes with lower bits alone, which is Owen's nested scrambling on reversed bits.
STIRS = (0x6A09E666, 0xBB67AE84, 0x3C6EF372, 0xA54FF53A)


def scramble_seeds(dimensions: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, 7]).integers(0, 1 << BITS, dimensions, dtype=np.uint64)


def sobol_points(first: int, n: int, dimensions: int, seed: int) -> np.ndarray:
    """Rows ``first`` to ``first + n`` of the scrambled sequence, (n, dimensions), in [0, 1)."""
    numbers = direction_numbers(dimensions)
    index = np.arange(first, first + n, dtype=np.uint64)
    x = np.zeros((n, dimensions), np.uint64)
    for k in range(BITS):
        x ^= ((index >> np.uint64(k)) & np.uint64(1))[:, None] * numbers[:, k]
    x = (_reversed_bits(x) + scramble_seeds(dimensions, seed)) & _MASK
    for stir in STIRS:
        x ^= (x * np.uint64(stir)) & _MASK
    return _reversed_bits(x) / float(1 << BITS)


class Saltelli:
    """A, B, AB and BA from one sequence of twice the parameters: of sample s, matrix m is design row ``s * (2 k + 2) + m``.

    Matrices come in the order A, B, AB of each parameter (A with that column of B), BA of each (B with that column of A).
    Units in [0, 1] are mapped to ``low`` and ``high`` of each parameter; those that aren't varied stay at their ``default``.
    """

    def __init__(self, samples: int, low, high, default=None, varied=None, seed: int = 1):
        self.samples, self.seed = samples, seed
        self.low, self.high = np.asarray(low, float), np.asarray(high, float)
        self.default = self.low if default is None else np.asarray(default, float)
        self.varied = list(range(len(self.low))) if varied is None else list(varied)
        self.matrices = 2 * len(self.varied) + 2

    @property
    def rows(self) -> int:
        return self.samples * self.matrices

    def vectors(self, first: int, n: int) -> np.ndarray:
        k, v = len(self.varied), self.varied
        sample, matrix = np.divmod(np.arange(first, first + n), self.matrices)
        begin = int(sample[0])
        points = sobol_points(begin, int(sample[-1]) - begin + 1, 2 * k, self.seed)[sample - begin]
        a, b = points[:, :k], points[:, k:]
        from_b = (matrix == 1) | (matrix >= k + 2)
        units = np.where(from_b[:, None], b, a)
        swapped = np.flatnonzero(matrix >= 2)
        column = (matrix[swapped] - 2) % k
        units[swapped, column] = np.where(from_b[swapped], a[swapped, column], b[swapped, column])
        out = np.repeat(self.default[None], n, axis=0)
        out[:, v] = self.low[v] + units * (self.high[v] - self.low[v])
        return out


class Listed:
    """A design of given rows: the default with some parameters set, (name or number, value) pairs for each row."""

    def __init__(self, default, changes: list[list[tuple[int, float]]]):
        self.table = np.repeat(np.asarray(default, float)[None], len(changes), axis=0)
        for row, pairs in enumerate(changes):
            for parameter, value in pairs:
                self.table[row, parameter] = value

    @property
    def rows(self) -> int:
        return len(self.table)

    def vectors(self, first: int, n: int) -> np.ndarray:
        return self.table[first : first + n]


def drawn_counts(first: int, n: int, slices: int, slice_rows: int, rows: int, resamples: int, seed: int) -> np.ndarray:
    """How often each row of a slice is drawn, (resamples, n): together with those of all other slices exactly ``rows`` draws.

    Rows ``first`` to ``first + n`` are slice ``first / slice_rows`` of ``slices``.  The draws of all rows are divided between the
    halves of a tree of slices by binomials, each told by its node's number, so a slice's task goes down one path and meets no other.
    """
    left, right, node = 0, slices, 1
    drawn = np.full(resamples, rows, np.int64)
    at = first // slice_rows
    while right - left > 1:
        middle = (left + right) // 2
        whole = min(rows, right * slice_rows) - left * slice_rows
        half = min(rows, middle * slice_rows) - left * slice_rows
        lower = np.random.default_rng([seed, node]).binomial(drawn, half / whole)
        if at < middle:
            drawn, right, node = lower, middle, 2 * node
        else:
            drawn, left, node = drawn - lower, middle, 2 * node + 1
    return np.random.default_rng([seed, node, 1]).multinomial(drawn, np.full(n, 1 / n))


class Morris:
    """Trajectories through the grid of ``levels`` values (an even number) of each varied parameter: one parameter moves in each step, by the same
    share of its range up or down, in an order of the trajectory's own.  Row ``t * (k + 1) + s`` is trajectory t after s steps.
    """

    def __init__(self, trajectories: int, low, high, default=None, varied=None, levels: int = 4, seed: int = 1):
        if levels % 2:
            raise ValueError("levels must be even, so that steps stay on the grid")
        self.trajectories, self.levels, self.seed = trajectories, levels, seed
        self.low, self.high = np.asarray(low, float), np.asarray(high, float)
        self.default = self.low if default is None else np.asarray(default, float)
        self.varied = list(range(len(self.low))) if varied is None else list(varied)
        self.step = levels / (2 * (levels - 1))

    @property
    def rows(self) -> int:
        return self.trajectories * (len(self.varied) + 1)

    def path(self, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where a trajectory begins (units), which way each parameter goes, and in what order they move."""
        k, rng = len(self.varied), np.random.default_rng([self.seed, t])
        low = rng.integers(0, self.levels // 2, k) / (self.levels - 1)
        sign = rng.choice([1.0, -1.0], k)
        return np.where(sign < 0, low + self.step, low), sign, rng.permutation(k)

    def vectors(self, first: int, n: int) -> np.ndarray:
        k, v = len(self.varied), self.varied
        out = np.repeat(self.default[None], n, axis=0)
        for row in range(n):
            t, s = divmod(first + row, k + 1)
            begin, sign, order = self.path(t)
            units = begin.copy()
            units[order[:s]] += self.step * sign[order[:s]]
            out[row, v] = self.low[v] + units * (self.high[v] - self.low[v])
        return out
