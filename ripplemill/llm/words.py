"""Words of whole texts as 64-bit hashes, and hashes of runs of words, a batch of texts at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = x + U64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def hashes(words: list[bytes]) -> np.ndarray:
    """Each distinct word is hashed once; nothing is kept from call to call."""
    known = {w: xxhash.xxh3_64_intdigest(w) for w in set(words)}
    return np.fromiter(map(known.__getitem__, words), dtype=U64, count=len(words))


def in_pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The rows in pieces of about ``limit`` bytes of text; one longer text is a piece by itself."""
    try:
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = _lengths(batch.column(batch.schema.get_field_index(text)))
            block = np.cumsum(lengths) // limit
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    yield batch.slice(a, b - a)
    finally:
        give_back()


def give_back() -> None:
    """At a task's end: what it has used goes back to the system, since Spark keeps its Python for the next task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def _lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)


def split(texts: list[bytes | None], lower: bool = False) -> tuple[list[list[bytes]], np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text (null: none) and where each text's words start."""
    each = [(t.lower() if lower else t).split() if t else [] for t in texts]
    start = np.zeros(len(each) + 1, dtype=np.int64)
    np.cumsum([len(w) for w in each], out=start[1:])
    return each, start


def flat(each: list[list[bytes]]) -> np.ndarray:
    return hashes([w for words in each for w in words])


class Runs:
    """Hashes of runs of consecutive words, of any length, from one sum over all words."""

    def __init__(self, word: np.ndarray):
        n = len(word)
        power = np.full(n + 1, BASE, dtype=U64)
        power[0] = 1
        np.cumprod(power, out=power)
        self.back = np.full(n + 1, INVERSE, dtype=U64)
        self.back[0] = 1
        np.cumprod(self.back, out=self.back)
        self.total = np.zeros(n + 1, dtype=U64)
        np.cumsum(mix(word) * power[:n], out=self.total[1:])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        value = (self.total[start + length] - self.total[start]) * self.back[start]
        return mix(value ^ (np.asarray(length).astype(U64) * U64(0xD6E8FEB86659FD93)))


#: Two primes below 2**31, and a base for each.
PRIMES = ((2147483647, 1331337997), (2147483629, 1917234941))
KEPT = 1 << 18


@lru_cache(maxsize=8)
def _kept_powers(base: int, prime: int) -> np.ndarray:
    return _powers(base, prime, KEPT)


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), by doubling."""
    out = np.ones(max(n, 1), dtype=U64)
    have, step = 1, base
    while have < n:
        m = min(have, n - have)
        out[have : have + m] = out[:m] * U64(step) % U64(prime)
        have, step = have + m, step * step % prime
    return out


class PrimeRuns:
    """Like ``Runs``, but from sums modulo two primes, on which regular patterns of words don't cancel out; ``salt`` gives other hashes."""

    def __init__(self, word: np.ndarray, salt: int = 0):
        n, self.parts = len(word), []
        table = _kept_powers if n < KEPT else lambda b, p: _powers(b, p, n + 1)
        value = mix(word, 17 + salt)
        for k, (prime, base) in enumerate(PRIMES):
            base = (base + 7919 * salt) % prime
            power, back = table(base, prime), table(pow(base, -1, prime), prime)
            total = np.zeros(n + 1, dtype=U64)
            np.cumsum((value >> U64(32 * k)) % U64(prime) * power[:n] % U64(prime), out=total[1:])
            self.parts.append((U64(prime), total % U64(prime), back))

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        end, out = start + length, np.zeros(len(start), dtype=U64)
        for prime, total, back in self.parts:
            out = out << U64(31) | (total[end] + prime - total[start]) % prime * back[start] % prime
        return mix(out ^ (np.asarray(length).astype(U64) * U64(0xD6E8FEB86659FD93)))
