"""Length-limited canonical Huffman codes over token ids, packed and unpacked in numpy."""

import numpy as np

MAX_BITS = 18
INTERVAL = 256


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` bits, by package-merge; 0 for unused ids."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} symbols do not fit codes of {max_bits} bits")
    if len(used) < 2:
        out[used] = 1
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    levels, packages = [], np.empty(0, np.int64)
    for _ in range(max_bits):
        merged = np.concatenate([weights, packages])
        by_weight = np.argsort(merged, kind="stable")
        levels.append(by_weight < len(weights))
        merged = merged[by_weight]
        packages = merged[:len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take, lengths = 2 * len(weights) - 2, np.zeros(len(weights), np.uint8)
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = lengths
    return out


class Code:
    """The canonical code of given lengths, with its decoding table."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = np.asarray(lengths, np.uint8)
        self.bits = max(int(self.lengths.max(initial=1)), 1)
        used = np.flatnonzero(self.lengths)
        symbols = used[np.lexsort((used, self.lengths[used]))]
        spans = np.left_shift(1, self.bits - self.lengths[symbols].astype(np.int64))
        ends = np.cumsum(spans)
        self.codes = np.zeros(len(self.lengths), np.uint64)
        self.codes[symbols] = (ends - spans) >> (self.bits - self.lengths[symbols].astype(np.int64))
        size = 1 << self.bits
        covered = int(ends[-1]) if len(ends) else 0
        if covered > size:
            raise ValueError("code lengths do not form a prefix code")
        self.symbol = np.zeros(size, np.uint32)
        self.width = np.ones(size, np.uint8)
        self.symbol[:covered] = np.repeat(symbols, spans)
        self.width[:covered] = np.repeat(self.lengths[symbols], spans)

    def encode(self, ids: np.ndarray, interval: int = INTERVAL) -> tuple[bytes, np.ndarray]:
        """The bit stream and the bit offset of every ``interval``-th id."""
        width = self.lengths[ids].astype(np.int64)
        if not width.all():
            raise ValueError("an id has no code")
        ends = np.cumsum(width)
        starts = ends - width
        total = int(ends[-1]) if len(ends) else 0
        # A code of at most 25 bits touches at most two 32-bit words; the parts of different codes
        # share no bit, so their sum is their union.
        word, shift = starts >> 5, 64 - (starts & 31) - width
        wide = self.codes[ids] << shift.astype(np.uint64)
        n = (total + 31 >> 5) + 1
        words = np.bincount(word, (wide >> np.uint64(32)).astype(np.float64), n)
        words[1:] += np.bincount(word, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), n)[:-1]
        return words.astype(">u4").tobytes()[:total + 7 >> 3], starts[::interval].astype("<u8")

    def decode(self, payload: bytes, n: int, offsets: np.ndarray, interval: int = INTERVAL) -> np.ndarray:
        """The ``n`` ids of a bit stream; all intervals advance together through the table."""
        lanes = len(offsets)
        raw = np.frombuffer(payload + bytes(interval * 4 + 8), np.uint8).astype(np.uint32)
        window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        out = np.empty((lanes, interval), np.uint32)
        at = offsets.astype(np.int64)
        mask, top = np.uint32((1 << self.bits) - 1), 32 - self.bits
        for step in range(min(interval, n)):
            peek = window[at >> 3] >> (top - (at & 7)).astype(np.uint32) & mask
            out[:, step] = self.symbol[peek]
            at += self.width[peek]
        return out.reshape(-1)[:n]
