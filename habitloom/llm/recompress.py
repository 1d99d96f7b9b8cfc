"""Consistent names for stretches of words, by rounds of run and pair naming.

In each round every symbol of a word sequence falls on one of two sides by its
name, and two neighbours on the left and right side become one symbol, named by
both; equal neighbours never pair, so a run stays a run. Names are digests of
what they stand for: every task gives equal pairs equal names without asking.
Whether a border between two symbols outlives r rounds depends on no more than
2 ** (r - 1) words on either side of it, so equal stretches of words have equal
symbols but for their rims. Borders inside runs of one word count as not
outliving any round.
"""

import numpy as np
import xxhash

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
# A random odd number per byte value, from a fixed seed.
_BYTES = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {}


def _mix(x):
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _power(base, n):
    """base ** 0 to base ** n modulo 2 ** 64."""
    held = _powers.get(base)
    if held is None or len(held) <= n:
        size = 1 << max(16, int(n).bit_length())
        held = np.full(size + 1, base, dtype=np.uint64)
        held[0] = 1
        held = _powers[base] = np.cumprod(held, dtype=np.uint64)
    return held[:n + 1]


def _stretch_hashes(values, first, last):
    """A 64-bit name of each stretch ``values[first:last]``, from prefix sums."""
    n = len(values)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * _power(_ODD, n)[:-1], dtype=np.uint64, out=sums[1:])
    return _mix((sums[last] - sums[first]) * _power(_INVERSE, n)[first])


def rounds_for(window: int) -> int:
    """Rounds after which a border is still judged inside a window of that many words."""
    return max(1, window.bit_length() - 1)


class Words:
    """The words of some documents, one after another, with windows, anchors and names.

    ``texts`` are UTF-8; words are runs of anything but ASCII white space.
    Every window of ``window`` words inside a document has an anchor: the
    border, as far from the window's ends as its judgement reaches, that
    outlives most rounds; ties go to the least name, then leftmost. Equal
    windows have equal anchors. Windows with one anchor follow each other.
    """

    def __init__(self, texts: list[bytes], window: int):
        lines = [b" ".join(t.split()) for t in texts]
        # A line feed can't be part of a word, so it marks the end of a document.
        self.joined = b"\n".join([*lines, b""])
        raw = np.frombuffer(self.joined, np.uint8)
        self.ends = np.flatnonzero((raw == 32) | (raw == 10))
        document_ends = np.flatnonzero(raw[self.ends] == 10)
        self.starts = np.concatenate([[0], self.ends[:-1] + 1]) if len(self.ends) else self.ends
        # An empty document leaves an empty word; it is dropped here.
        real = self.starts < self.ends
        counts = np.diff(np.concatenate([[0], np.cumsum(real)[document_ends]])) if len(document_ends) else np.zeros(0, int)
        self.starts, self.ends, self.counts = self.starts[real], self.ends[real], counts
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.window = window
        names = _stretch_hashes(_BYTES[raw], self.starts, self.ends) if len(self.starts) else np.zeros(0, np.uint64)
        document = np.repeat(np.arange(len(texts)), counts)
        n = len(names)
        self.windows = np.flatnonzero(document[:max(0, n - window + 1)] == document[window - 1:]) if n >= window else np.zeros(0, int)
        self.document = document
        self._anchor(names)

    def _anchor(self, names):
        n, rounds = len(names), rounds_for(self.window)
        reach = 1 << (rounds - 1)
        self.anchor_of = np.zeros(0, int)
        self.anchors = np.zeros(0, int)
        self.names = np.zeros(0, np.uint64)
        if not len(self.windows):
            return
        outlived = np.zeros(n, dtype=np.uint64)
        symbol, start, document = names, np.arange(n), self.document
        for r in range(1, rounds + 1):
            salt = np.uint64(r * 0x1234567 + 5)
            right = (_mix(symbol + salt) & np.uint64(1)).astype(bool)
            pair = np.zeros(len(symbol), bool)
            pair[:-1] = ~right[:-1] & right[1:] & (document[1:] == document[:-1])
            at = np.flatnonzero(pair)
            symbol = symbol.copy()
            symbol[at] = _mix(symbol[at] * np.uint64(_ODD) + _mix(symbol[at + 1]) + salt)
            alive = np.concatenate([[True], ~pair[:-1]])
            symbol, start, document = symbol[alive], start[alive], document[alive]
            outlived[start] = r
        outlived[1:][names[1:] == names[:-1]] = 0
        around = np.arange(reach, n - reach + 1)
        around_names = np.zeros(n + 1, dtype=np.uint64)
        around_names[around] = _stretch_hashes(names, around - reach, around + reach)
        # Fewer rounds outlived, then the name: the least is the anchor.
        order = around_names >> np.uint64(6)
        order[:n] |= (np.uint64(rounds) - outlived) << np.uint64(58)
        best, at = order[self.windows + reach], self.windows + reach
        for step in range(1, self.window - 2 * reach + 1):
            other = order[self.windows + reach + step]
            better = other < best
            best = np.where(better, other, best)
            at = np.where(better, self.windows + reach + step, at)
        new = np.concatenate([[True], (at[1:] != at[:-1])])
        #: Index into ``windows`` of each anchor's first window.
        self.anchors = np.flatnonzero(new)
        self.anchor_of = np.cumsum(new) - 1
        self.names = around_names[at[self.anchors]]

    def stretches(self) -> np.ndarray:
        """Digest of the words under all windows of each anchor."""
        if not len(self.anchors):
            return np.zeros(0, np.uint64)
        first = self.windows[self.anchors]
        last = self.windows[np.concatenate([self.anchors[1:], [len(self.windows)]]) - 1] + self.window - 1
        joined, digest = self.joined, xxhash.xxh3_64_intdigest
        return np.array([digest(joined[s:e]) for s, e in zip(self.starts[first].tolist(), self.ends[last].tolist(), strict=True)], dtype=np.uint64)

    def window_digests(self, windows) -> np.ndarray:
        """128-bit digests of the words of the given windows, as pairs of longs."""
        first = self.windows[windows]
        joined, digest = self.joined, xxhash.xxh3_128_digest
        raw = b"".join([digest(joined[s:e]) for s, e in zip(self.starts[first].tolist(), self.ends[first + self.window - 1].tolist(), strict=True)])
        return np.frombuffer(raw, dtype=np.int64).reshape(-1, 2)
