"""Words, word hashes and Rabin-Karp window hashes of whole texts (numpy).

Texts arrive as UTF-8 bytes.  ``bytes.split()`` cuts at exactly the six ASCII
white-space bytes 0x20 and 0x09-0x0D, so it yields the words
``[^\\x20\\x09-\\x0D]+``; ``bytes.lower()`` lowers exactly A-Z.
"""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

U = np.uint64
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def word_hashes(words: list) -> np.ndarray:
    """XXH3 of every word (bytes, or text as UTF-8); quicker than to look words up."""
    return np.fromiter(map(xxh3_64_intdigest, words), U, len(words))


def power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2**64, n of each at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(4096, 1 << (n - 1).bit_length())
        both = []
        for x in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, x, U)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = _powers[base] = (both[0], both[1])
    return have


def mix(a: np.ndarray) -> np.ndarray:
    """Bijective finaliser: spreads polynomial hashes over all 64 bits."""
    a = a ^ (a >> U(30))
    a = a * U(0xBF58476D1CE4E5B9)
    a ^= a >> U(27)
    a *= U(0x94D049BB133111EB)
    return a ^ (a >> U(31))


def windows(hashes: np.ndarray, k: int, base: int = BASES[0]) -> np.ndarray:
    """Rabin-Karp hash of every window of k hashes, in O(1) per window.

    Prefix sums of h[i] * base**i turn a window into one subtraction; the
    inverse power brings it to a common origin.  Empty if there are fewer than k.
    """
    n = len(hashes)
    if n < k:
        return np.zeros(0, U)
    up, down = power_tables(base, n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum(hashes * up[:n], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[: n - k + 1])


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by doubling."""
    have = 1
    while 2 * have <= w:
        a = np.minimum(a[: len(a) - have], a[have:])
        have *= 2
    rest = w - have
    return np.minimum(a[: len(a) - rest], a[rest:]) if rest else a


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of k words that begins at one of starts."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + k, n), -1)
    return np.cumsum(change[:n]) > 0
