"""Hashed word n-grams and two learners over them: FTRL logistic regression, and sentences under noisy-or."""

from __future__ import annotations

import re

import numpy as np
import xxhash

from .words import U64, hashes, mix

BITS = 18
SIZE = 1 << BITS
#: Words of letters and digits (and bytes beyond ASCII), or runs of other signs.
TOKEN = re.compile(rb"[0-9A-Za-z_\x80-\xff]+|[^\s0-9A-Za-z_\x80-\xff]+")
#: The same, and the ends of sentences.
PIECE = re.compile(rb"[0-9A-Za-z_\x80-\xff]+|[^\s0-9A-Za-z_\x80-\xff]+|\n+")
SAME = U64(0x5BD1E995)


def ngrams(texts: list[bytes | None], order: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 1..order-grams of each text, and where each text's buckets start.

    A word that repeats the one before counts as one sign for "the same again" within
    n-grams, so that repetition is a feature whatever the word.
    """
    each = [TOKEN.findall(t.lower()) if t else [] for t in texts]
    size = np.array([len(w) for w in each], dtype=np.int64)
    start = np.concatenate(([0], np.cumsum(size)))
    word = hashes([w for words in each for w in words])
    where = np.arange(len(word))
    first = np.repeat(start[:-1], size)
    repeat = np.zeros(len(word), dtype=bool)
    repeat[1:] = word[1:] == word[:-1]
    repeat &= where > first
    grams = [mix(word)]
    sign = np.where(repeat, SAME, word)
    for n in range(2, order + 1):
        h = np.zeros(len(word), dtype=U64)
        for k in range(n - 1, -1, -1):
            h = mix(h ^ np.concatenate((np.zeros(min(k, len(word)), U64), (sign if k == 0 else word)[: max(0, len(word) - k)])), n)
        grams.append(np.where(where >= first + n - 1, np.where(repeat, mix(np.full(1, SAME), n), h), U64(0)))
    # unigrams and higher ones of a place side by side; those that begin before the text are left out
    table = np.stack([g >> U64(64 - BITS) for g in grams], axis=1).astype(np.int32)
    there = np.stack([where >= first + n for n in range(order)], axis=1)
    count = np.add.reduceat(np.append(there.sum(1), 0), np.minimum(start[:-1], len(word))) * (size > 0) if len(texts) else np.zeros(0)
    return table[there], np.concatenate(([0], np.cumsum(count))).astype(np.int64)


def sums(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The sum of each piece; an empty piece has 0."""
    out = np.add.reduceat(np.append(values, 0.0), start[:-1]) if len(start) > 1 else np.zeros(0)
    return np.where(start[1:] > start[:-1], out, 0.0)


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


class Ftrl:
    """Follow the regularised leader, per coordinate (proximal, with L1 and L2)."""

    def __init__(self, alpha: float, beta: float, l1: float, l2: float, size: int = SIZE + 1, z=None, n=None):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros(size) if z is None else z
        self.n = np.zeros(size) if n is None else n

    def weights(self, i=slice(None)) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, i: np.ndarray, w: np.ndarray, g: np.ndarray) -> None:
        """``i``: distinct coordinates."""
        n = self.n[i]
        new = n + g * g
        self.z[i] += g - (np.sqrt(new) - np.sqrt(n)) / self.alpha * w
        self.n[i] = new

    def bias(self) -> float:
        z, n = self.z[-1], self.n[-1]
        return float(-z / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))


def sparse(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of one document and the share of its n-grams each has."""
    i, n = np.unique(buckets, return_counts=True)
    return i, n / max(len(buckets), 1)


#: Shares of n-grams are small numbers; documents are scaled to so many n-grams.
SCALE = 20.0


def train_quality(model: Ftrl, docs: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
    for i, x, y in docs:
        x = x * SCALE
        w, b = model.weights(i), model.bias()
        g = sigmoid(float(w @ x) + b) - y
        model.update(i, w, g * x)
        model.update(np.array([SIZE]), np.array([b]), np.array([g]))


def score_quality(w: np.ndarray, b: float, texts: list[bytes | None], order: int = 2) -> np.ndarray:
    buckets, start = ngrams(texts, order)
    return sigmoid(sums(w[buckets], start) / np.maximum(np.diff(start), 1) * SCALE + b)


#: Log-odds of a sentence without any known word.
FLOOR = -9.0
STEMS = range(4, 9)
LONGEST = 64


def word_features(words: list[bytes]) -> np.ndarray:
    """Buckets of each word and of its beginnings, which words of one stem share; SIZE where there is none."""
    table = np.full((len(words), 1 + len(STEMS)), SIZE, dtype=np.int32)
    if words:
        table[:, 0] = mix(hashes(words)) >> U64(64 - BITS)
        length = np.fromiter(map(len, words), np.int64, len(words))
        for c, k in enumerate(STEMS, 1):
            parts = np.fromiter((xxhash.xxh3_64_intdigest(w[:k]) for w in words), U64, len(words))
            table[:, c] = np.where(length > k, (mix(parts, k) >> U64(64 - BITS)).astype(np.int32), SIZE)
    return table


def _kind(token: bytes) -> int:
    """0: a word, 1: signs within a sentence, 2: the end of a sentence."""
    c = token[0]
    if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 or c == 95:
        return 0
    return 2 if c == 10 or c in b".!?" or token[-1] in b".!?" else 1


def pieces(texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray]:
    """The tokens of all texts, and where each text's begin."""
    each = [PIECE.findall(t.lower()) if t else [] for t in texts]
    return [w for one in each for w in one], np.concatenate(([0], np.cumsum([len(x) for x in each], dtype=np.int64)))


def sentences(kind: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first token of each sentence, the text of each, whether it has words).

    A sentence ends at a line end, at signs with ``.``, ``!`` or ``?``, at the end of its
    text, and after 64 tokens at the latest.
    """
    n = len(kind)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    begins = np.zeros(n, dtype=bool)
    begins[start[:-1][start[:-1] < n]] = True
    begins[1:] |= kind[:-1] == 2
    last = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
    first = np.flatnonzero(begins | ((np.arange(n) - last) % LONGEST == 0))
    return first, np.searchsorted(start, first, side="right") - 1, np.add.reduceat((kind == 0).astype(np.int64), first) > 0


def train_toxic(model: Ftrl, docs: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
    """``docs``: (buckets, their sentences, label). Each sentence's share of the gradient follows from noisy-or."""
    for buckets, sentence, y in docs:
        if not len(buckets):
            continue
        i, back = np.unique(buckets, return_inverse=True)
        w = model.weights(i)
        p = sigmoid(np.bincount(sentence, weights=w[back]) + FLOOR)
        log_clean = np.log1p(-np.minimum(p, 1 - 1e-12)).sum()
        slope = p if not y else -p * np.exp(log_clean) / max(-np.expm1(log_clean), 1e-9)
        g = np.bincount(back, weights=slope[sentence], minlength=len(i))
        model.update(i, w, np.clip(g, -1.0, 1.0))


def toxic_examples(texts: list[bytes | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, their sentences counted from 0) of each text."""
    tokens, start = pieces(texts)
    kind = np.fromiter(map(_kind, tokens), np.int8, len(tokens))
    first, _, wordy = sentences(kind, start)
    number = np.cumsum(wordy) - 1
    sentence = np.repeat(number, np.diff(np.append(first, len(tokens))))
    out = []
    for a, b in zip(start, start[1:]):
        at = np.flatnonzero(kind[a:b] == 0) + a
        table = word_features([tokens[k] for k in at])
        of = np.repeat(sentence[at] - (sentence[at[0]] if len(at) else 0), table.shape[1])
        keep = table.ravel() < SIZE
        out.append((table.ravel()[keep], of[keep]))
    return out


class WordWeights(dict):
    """The summed weight of each word's features (inf: a sentence's end, -inf: other signs); emptied when it has grown."""

    def __init__(self, w: np.ndarray):
        self.w = np.append(w[:SIZE], 0.0)

    def of(self, tokens: list[bytes]) -> np.ndarray:
        if len(self) > 300_000:
            self.clear()
        new = [t for t in set(tokens) if t not in self]
        kind = np.fromiter(map(_kind, new), np.int8, len(new))
        value = self.w[word_features(new)].sum(1)
        self.update(zip(new, np.where(kind == 2, np.inf, np.where(kind == 1, -np.inf, value)).tolist()))
        return np.fromiter(map(self.__getitem__, tokens), np.float64, len(tokens))


def score_toxic(weights: WordWeights, texts: list[bytes | None]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(noisy-or score of each text, the probabilities of its sentences); 0 without words."""
    tokens, start = pieces(texts)
    value = weights.of(tokens)
    kind = np.where(value == np.inf, 2, np.where(value == -np.inf, 1, 0))
    value[kind > 0] = 0.0
    first, text, wordy = sentences(kind, start)
    z = np.add.reduceat(value, first) if len(first) else np.zeros(0)
    p = np.where(wordy, sigmoid(z + FLOOR), 0.0)
    clean = np.bincount(text, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(texts))
    return -np.expm1(clean), np.split(p, np.searchsorted(text, np.arange(1, len(texts)))) if len(texts) else []
