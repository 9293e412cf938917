"""Vectorised scans of words in whole texts: one 64-bit hash and one shape mask a word, n-grams of either.

Words are runs of bytes other than space, tab, newline, vertical tab, form feed and carriage return. Many
texts are scanned as one buffer; a long text is scanned in segments cut between words, so a scan needs
memory for a segment's bytes and eight bytes a word. Hashes stand for words; two of n different words share one
with a chance of about n**2 / 2**65.
"""

from __future__ import annotations

import re

import numpy as np

SEGMENT = 1 << 20
SPACE = np.zeros(256, bool)
_GAP = re.compile(rb"[\x20\x09-\x0D]")
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_rng = np.random.default_rng(20)
_GRAM = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Bits of a word's shape.
LETTER, UPPER, DIGIT, STOP, COMMA, BANG, BAR, SYMBOL, OTHER, AGAIN, CAPITAL = (1 << i for i in range(11))
_SHAPE = np.full(256, OTHER, np.uint16)
_SHAPE[0x80:] = LETTER
for _chars, _bit in ((b"abcdefghijklmnopqrstuvwxyz", LETTER), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", UPPER), (b"0123456789", DIGIT), (b".", STOP), (b",", COMMA), (b"!?", BANG), (b"|", BAR), (b"#*$%&<>", SYMBOL)):
    _SHAPE[list(_chars)] = _bit


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_TAIL = np.array([(1 << 8 * n) - 1 for n in range(1, 9)], np.uint64)
_PLACES = 1 << 16
_PLACE = mixed(np.arange(1, _PLACES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def run_hashes(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes (none empty).

    A run is read in units of eight bytes. Each unit is mixed with its place before they are added up, and the
    mixing is not linear, so no exchange of units cancels out as it does in a polynomial of the bytes.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    units = np.ndarray((len(buf) + 1,), "<u8", buffer=padded, strides=(1,))
    n = (lengths + 7) >> 3
    first = np.cumsum(n) - n
    k = np.arange(int(n.sum())) - np.repeat(first, n)
    left = np.minimum(np.repeat(lengths, n) - 8 * k, 8)
    place = _PLACE[k & (_PLACES - 1)] + (k >> 16).astype(np.uint64)
    unit = mixed((units[np.repeat(starts, n) + 8 * k] & _TAIL[left - 1]) ^ place)
    return mixed(np.add.reduceat(unit, first) ^ (lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def _segments(text: bytes):
    at = 0
    while len(text) - at > SEGMENT:
        gap = _GAP.search(text, at + SEGMENT)
        to = gap.start() if gap else len(text)
        yield text[at:to]
        at = to
    yield text[at:]


def _scan(joined: bytes, shapes: bool):
    buf = np.frombuffer(joined, np.uint8)
    solid = ~SPACE[buf]
    edge = np.diff(solid.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64), np.zeros(0, np.uint16)
    lengths = ends - starts
    hashes = run_hashes(buf, starts, lengths)
    mask = np.zeros(len(starts), np.uint16)
    if shapes:
        inner, first = buf[solid], np.cumsum(lengths) - lengths
        mask = np.bitwise_or.reduceat(_SHAPE[inner], first)
        mask[_SHAPE[inner[first]] == UPPER] |= CAPITAL
    return starts, ends, hashes, mask


class Words:
    """hashes (and shapes) of the words of all texts, one after another; text i has words from[i] to to[i]."""

    def __init__(self, texts: list[bytes], shapes: bool = False):
        found, counts, held, size = [], [], [], 0

        def scan_held():
            nonlocal held, size
            if held:
                starts, _, h, m = _scan(b"\n".join(held), shapes)
                offs = np.cumsum([0, *[len(t) + 1 for t in held]])
                counts.extend(np.diff(np.searchsorted(starts, offs)).tolist())
                found.append((h, m))
                held, size = [], 0

        for t in texts:
            if len(t) > SEGMENT:
                scan_held()
                parts = [_scan(s, shapes)[2:] for s in _segments(t)]
                found.extend(parts)
                counts.append(sum(len(h) for h, _ in parts))
            else:
                held.append(t)
                size += len(t)
                if size > SEGMENT:
                    scan_held()
        scan_held()
        self.hashes = np.concatenate([h for h, _ in found]) if found else np.zeros(0, np.uint64)
        self.to = np.cumsum(counts, dtype=np.int64)
        self.from_ = self.to - np.array(counts, np.int64)
        if shapes:
            self.shapes = np.concatenate([m for _, m in found]) if found else np.zeros(0, np.uint16)
            same = np.zeros(len(self.hashes), bool)
            same[1:] = self.hashes[1:] == self.hashes[:-1]
            same[self.from_[self.from_ < self.to]] = False
            self.shapes[same] |= AGAIN


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words in h (none where h is shorter)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if k == 1:
        return h
    total = h[:n] * _GRAM[0]
    for j in range(1, k):
        total = total + h[j : j + n] * _GRAM[j]
    return mixed(total)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """As grams, but the whole sequence where it has fewer words, as long as it has one."""
    return grams(h, min(k, len(h))) if len(h) else np.zeros(0, np.uint64)


def features(words: Words, i: int, bits: int) -> list[np.ndarray]:
    """Bucket numbers of text i's hashed n-grams, by family: words, word pairs, shapes of one, two and three words."""
    h, s = words.hashes[words.from_[i] : words.to[i]], words.shapes[words.from_[i] : words.to[i]].astype(np.uint64)
    t = mixed(s + np.uint64(1))
    shift = np.uint64(64 - bits)
    out = []
    for salt, g in enumerate((grams(h, 1), grams(h, 2), t, grams(t, 2), grams(t, 3))):
        out.append((((g + np.uint64(salt)) * _GRAM[8 + salt]) >> shift).astype(np.int32))
    return out
