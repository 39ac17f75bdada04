"""Windows of a symbol sequence grouped into content-defined blocks.

A window is `length` consecutive symbols (words or bytes). Its anchor is the
leftmost smallest-hash gram of `gram` symbols in it, so equal windows have
equal anchors at equal distances. A block is a run of neighbouring windows with
one anchor. Comparing blocks by (anchor, digest of the block's own text) settles most
windows without looking at them one at a time; where two different blocks share an
anchor, their windows are compared one by one. Anchors only bring together what may be
equal; that it is equal is said by a digest of the real words or bytes, or by comparing them.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

_U = np.uint64
#: Hashes of runs are polynomials modulo this prime. Modulo a power of two, whole families of words collide whatever the base.
_PRIME = (1 << 61) - 1
_BASE = 0x0B5AD4ECEDA1CE2A  # drawn at random, below the prime
_INVERSE = pow(_BASE, -1, _PRIME)
_P, _LOW, _S31, _S61 = _U(_PRIME), _U((1 << 31) - 1), _U(31), _U(61)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mod(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> _S61)
    return np.where(x >= _P, x - _P, x)


def _shifted(x: np.ndarray) -> np.ndarray:
    """x * 2**31, not yet below the prime; x is below 2**61."""
    return (x >> _U(30)) + ((x & _U((1 << 30) - 1)) << _S31)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, of numbers below it."""
    a_high, a_low, b_high, b_low = a >> _S31, a & _LOW, b >> _S31, b & _LOW
    return _mod(a_high * b_high * _U(2) + _shifted(a_high * b_low + a_low * b_high) + a_low * b_low)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo the prime for i up to n."""
    while len(_powers[0]) < n + 1:
        for k, base in enumerate((_BASE, _INVERSE)):
            known = _powers[k]
            _powers[k] = np.concatenate([known, _times(known, np.full(len(known), pow(base, len(known), _PRIME), np.uint64))])
    return _powers[0][: n + 1], _powers[1][: n + 1]


def scramble(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(29)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(32)
    return h


class RunHash:
    """Hash of any run of a symbol sequence in constant time. Equal runs have equal hashes; two others collide with a chance of about their length in 2**61."""

    def __init__(self, symbols: np.ndarray):
        power, self.inverse = _power_tables(len(symbols))
        power = power[: len(symbols)]
        if symbols.dtype == np.uint8:  # products stay small: nothing to reduce before the sums
            few = symbols.astype(np.uint64) + _U(1)
            low, high = (power & _LOW) * few, (power >> _S31) * few
        else:
            own = _times(_mod(symbols), power)
            low, high = own & _LOW, own >> _S31
        self.prefix = np.zeros(len(symbols) + 1, np.uint64)
        self.prefix[1:] = _mod(_shifted(_mod(np.cumsum(high, dtype=np.uint64))) + _mod(np.cumsum(low, dtype=np.uint64)))

    def _of(self, before: np.ndarray, after: np.ndarray, inverse: np.ndarray) -> np.ndarray:
        return scramble(_times(_mod(after + _P - before), inverse))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self._of(self.prefix[start], self.prefix[end], self.inverse[start])

    def grams(self, size: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Hashes of the runs of `size` symbols between two places."""
        n = (len(self.prefix) - 1 if hi is None else hi) - lo - size + 1
        return self._of(self.prefix[lo : lo + n], self.prefix[lo + size : lo + size + n], self.inverse[lo : lo + n])


def digests(pieces) -> np.ndarray:
    """A 64-bit BLAKE2 digest of each byte string, by which strings with one anchor are held equal."""
    digest = hashlib.blake2b
    return np.frombuffer(b"".join([digest(x, digest_size=8).digest() for x in pieces]), np.int64)


class RollingHash(RunHash):
    """Like RunHash, but modulo 2**64: quick, with families of runs that collide. Good for choosing places, not for telling what is equal."""

    _base = 0x9E3779B97F4A7C15
    _tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def __init__(self, symbols: np.ndarray):
        tables, n = RollingHash._tables, len(symbols)
        if len(tables[0]) < n + 1:
            for k, base in enumerate((self._base, pow(self._base, -1, 1 << 64))):
                steps = np.full(max(n + 1, 1 << 20), base, np.uint64)
                steps[0] = 1
                tables[k] = np.cumprod(steps)
        self.inverse = tables[1][: n + 1]
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((symbols.astype(np.uint64) + _U(1)) * tables[0][:n], out=self.prefix[1:])

    def _of(self, before: np.ndarray, after: np.ndarray, inverse: np.ndarray) -> np.ndarray:
        return scramble((after - before) * inverse)


class Combiner:
    """Drops the rows of a task that say nothing new about a key met before.

    A key (of one or two numbers) that occurs more than once in a run is remembered with its smallest place (an id, or a pair), so
    that a hot key leaves a task about once and not once a run. Up to `room` keys are held; forgetting one costs a row, no result.
    """

    def __init__(self, room: int = 1 << 16):
        self.room, self.least, self.held = room, {}, np.zeros(0, np.int64)

    def news(self, key: tuple[np.ndarray, ...], place: tuple[np.ndarray, ...], repeated: np.ndarray) -> np.ndarray:
        """Mask of the rows to pass on."""
        keep, before = np.ones(len(repeated), bool), len(self.least)
        at = np.searchsorted(self.held, key[-1])
        known = self.held[np.minimum(at, len(self.held) - 1)] == key[-1] if len(self.held) else np.zeros(len(repeated), bool)
        look = np.flatnonzero(repeated | known)
        keys, places = (list(zip(*(x[look].tolist() for x in columns), strict=True)) for columns in (key, place))
        for k, own, where in zip(look.tolist(), keys, places, strict=True):
            met = self.least.get(own)
            if met is not None and met <= where:
                keep[k] = False
            elif met is not None or repeated[k]:
                self.least[own] = where
        if len(self.least) > self.room:
            self.least.clear()
        if len(self.least) != before:
            self.held = np.sort(np.fromiter((x[-1] for x in self.least), np.int64, len(self.least)))
        return keep


def word_symbols(data: np.ndarray, offsets: np.ndarray, piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each whitespace-separated word, offset of each row's first word and the end)."""
    if len(data) <= 2 * piece:
        starts, hashes = _words(data, offsets)
        return hashes, np.searchsorted(starts, offsets)
    # One row that is longer than a run: hash it piece by piece, cut at whitespace.
    space = np.flatnonzero((data == 32) | ((data >= 9) & (data <= 13)))
    start, found = 0, []
    while start < len(data):
        k = np.searchsorted(space, start + piece)
        end = int(space[k]) + 1 if k < len(space) else len(data)
        found.append(_words(data[start:end], np.array([0, end - start]))[1])
        start = end
    hashes = np.concatenate(found)
    return hashes, np.array([0, len(hashes)])


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = word.copy()
    first[1:] &= ~word[:-1]
    cut = offsets[(offsets > 0) & (offsets < n)]
    first[cut] = word[cut]
    starts = np.flatnonzero(first)
    stop = np.zeros(n + 1, bool)
    stop[:n] = ~word
    stop[offsets] = True
    stops = np.flatnonzero(stop)
    ends = stops[np.searchsorted(stops, starts, side="right")]
    return starts, RunHash(data).of(starts, ends)


@dataclass
class Blocks:
    """Arrays with an entry per block: row of the batch run, first window, number of windows, place and hash of the anchor."""

    row: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    at: np.ndarray
    anchor: np.ndarray


def find_blocks(symbols: np.ndarray, offsets: np.ndarray, length: int, gram: int, piece: int = 1 << 20) -> Blocks:
    """Blocks of every row; `start` and `at` count symbols from the start of the run.

    A row beyond `piece` symbols is cut into overlapping pieces. That may split a
    block, which makes it compare window by window but changes no result.
    """
    run = RollingHash(symbols)
    parts = []
    for lo in range(0, max(1, len(symbols) - length + 1), piece):
        hi = min(len(symbols), lo + piece + length - 1)
        if hi - lo >= length:
            parts.append(_piece(run, lo, hi, offsets, length, gram))
    cols = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(3)]
    start, windows, at = cols
    row = np.searchsorted(offsets, start, side="right") - 1
    return Blocks(row, start, windows, at, run.of(at, at + gram).view(np.int64))


def _piece(run: RollingHash, lo: int, hi: int, offsets: np.ndarray, length: int, gram: int):
    span = length - gram + 1
    n = hi - lo - gram + 1
    # The low bits hold the position: ties go to the leftmost gram.
    key = (run.grams(gram, lo, hi) & _U(~0x1FFFFFF & (2**64 - 1))) | np.arange(n, dtype=np.uint64)
    width = 1
    while width < span:
        step = min(width, span - width)
        key = np.minimum(key[:-step], key[step:])
        width += step
    at = (key & _U(0x1FFFFFF)).astype(np.int64)
    inside = np.ones(len(at), bool)
    for edge in offsets[(offsets > lo) & (offsets < hi)]:
        inside[max(0, edge - lo - length + 1) : edge - lo] = False
    where = np.flatnonzero(inside)
    if not len(where):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    own = at[where]
    new = np.ones(len(where), bool)
    new[1:] = (own[1:] != own[:-1]) | (where[1:] != where[:-1] + 1)
    # Windows on the two sides of a row's edge never share a block.
    edges = np.searchsorted(where, offsets[(offsets > lo) & (offsets < hi)] - lo)
    new[edges[edges < len(where)]] = True
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(where)))
    return where[first] + lo, count, own[first] + lo


def covered(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Mask of the positions inside any of the half-open ranges."""
    delta = np.bincount(starts, minlength=size + 1)[: size + 1] - np.bincount(ends, minlength=size + 1)[: size + 1]
    return np.cumsum(delta)[:size] > 0


def span_count(mask: np.ndarray) -> int:
    return int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()) if len(mask) else 0
