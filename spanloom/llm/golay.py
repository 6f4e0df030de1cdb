"""The binary Golay code: codewords near a word, and the one nearest to a row of votes."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: Generator polynomial of the perfect (23, 12) Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: Bits of a word.
LENGTH = 23
#: Of a row of votes, so many of the weakest are tried either way.
WEAK = 4


@cache
def golay() -> tuple[np.ndarray, np.ndarray]:
    """Per syndrome of a 23-bit word: the error to its nearest codeword, and what leads from there to the codewords at distance 4.

    Every word is at distance 3 or less of exactly one codeword. A word at distance 3 has five codewords at distance
    4, at the other words none: they differ from the nearest by a codeword of weight 7 that covers the error.
    """
    def rest(x: int) -> int:
        for bit in range(22, 10, -1):
            if x >> bit & 1:
                x ^= GENERATOR << (bit - 11)
        return x

    error = np.zeros(2048, np.int64)
    for weight in (1, 2, 3):
        for where in combinations(range(23), weight):
            e = sum(1 << b for b in where)
            error[rest(e)] = e
    heavy = [c for c in ((d << 11) | rest(d << 11) for d in range(4096)) if c.bit_count() == 7]
    further = np.zeros((2048, 5), np.int64)
    for s in range(2048):
        if int(error[s]).bit_count() == 3:
            further[s] = [c for c in heavy if c & int(error[s]) == int(error[s])]
    return error, further


def syndrome(words: np.ndarray) -> np.ndarray:
    x = words.copy()
    for bit in range(22, 10, -1):
        x ^= np.where(x >> bit & 1, GENERATOR << (bit - 11), 0)
    return x


def codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 6) indices of codewords near each 23-bit word, and which of them count.

    The nearest codeword, and of those at distance 4 the ones above it. Words that differ in one bit at most share
    one: if their nearest codewords differ, each is at distance 4 of the other word, and both take the larger.
    """
    error, further = golay()
    s = syndrome(words)
    nearest = words ^ error[s]
    near = nearest[:, None] ^ further[s]
    return np.concatenate([nearest[:, None], near], axis=1) >> 11, np.concatenate([np.ones((len(words), 1), bool), (further[s] > 0) & (near > nearest[:, None])], axis=1)


def decoded(votes: np.ndarray) -> np.ndarray:
    """Index of the codeword that each row of LENGTH votes decodes to.

    A vote above 0 stands for a set bit. Of the codewords nearest to the word of these bits with any of its WEAK weakest
    turned, it is the one whose differing bits have the least votes.
    """
    error, _ = golay()
    place = np.int64(1) << np.arange(LENGTH)
    column = syndrome(place)
    weight = np.abs(votes).astype(np.float32)
    word = (votes > 0) @ place
    weak = np.argpartition(weight, WEAK - 1, axis=1)[:, :WEAK]
    turned, s = np.zeros((len(word), 1), np.int64), syndrome(word)[:, None]
    for k in range(WEAK):
        turned = np.concatenate([turned, turned ^ place[weak[:, k], None]], axis=1)
        s = np.concatenate([s, s ^ column[weak[:, k], None]], axis=1)
    turned ^= error[s]
    bits = np.unpackbits(turned.astype("<u4").view(np.uint8).reshape(*turned.shape, 4), axis=2, count=LENGTH, bitorder="little")
    cost = np.einsum("nkb,nb->nk", bits, weight)
    return (word ^ turned[np.arange(len(word)), cost.argmin(axis=1)]) >> 11
