"""The (23, 12) binary Golay code: every 23-bit word is within 3 bits of exactly one codeword."""

from itertools import combinations

import numpy as np

BITS, CHECK_BITS = 23, 11
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def syndrome(words: np.ndarray) -> np.ndarray:
    """The remainder modulo the generator, 0 for codewords."""
    out = words.astype(np.int64)
    for bit in range(BITS - 1, CHECK_BITS - 1, -1):
        out = np.where(out >> bit & 1, out ^ GENERATOR << bit - CHECK_BITS, out)
    return out


def _patterns() -> tuple[np.ndarray, np.ndarray]:
    """Per syndrome: the bit patterns of weight 4 or less that lead to a codeword, and their number.

    The lightest comes first. A word at distance 3 from its codeword has five further codewords at
    distance 4; any other word has no second one within 4.
    """
    found = np.zeros((1 << CHECK_BITS, 6), np.int64)
    number = np.zeros(1 << CHECK_BITS, np.int64)
    for weight in range(5):
        masks = np.array([sum(1 << b for b in bits) for bits in combinations(range(BITS), weight)], np.int64)
        for mask, at in zip(masks.tolist(), syndrome(masks).tolist()):
            if weight < 4 or number[at] and found[at, 0].bit_count() == 3:
                found[at, number[at]] = mask
                number[at] += 1
    return found, number


PATTERNS, NUMBER = _patterns()
SYNDROMES = syndrome(np.arange(1 << 16))


def near_indices(segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices (12 bits) within 4 bits of 16-bit segments: (n, 6) and how many are valid.

    The first is the nearest codeword's. Two segments that differ in at most one bit share the
    nearest index of either among these.
    """
    at = SYNDROMES[segments]
    return (segments[:, None] ^ PATTERNS[at]) >> CHECK_BITS, NUMBER[at]
