"""Token ids of whole texts with the tokenizers library.

Byte-level BPE cuts a text before every space that a non-space follows and before a newline between
non-spaces, so where no white space touches white space the ids of a text are the ids of these pieces one after
another. `Encoder` scans a buffer of many texts at once, looks all pieces up by a 64-bit hash in a table of
bounded size, compares their bytes with those in the table, and sends only new pieces to the tokenizer, many in
one call. Other texts, those that hold two pieces of one hash, and tokenizers with any other pre-tokenizer or with a normaliser, are encoded whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from .words import run_hashes

#: White space before white space or the end, or after white space: U+180E counts as such, since libraries differ on it.
_ODD = re.compile("[\\s\u180e](?![^\\s\u180e])")
_CUT = re.compile(rb"[ \n]")
_SEGMENT = 1 << 20
#: Bytes of the pieces in a table, about: a segment's pieces may be added once it holds fewer.
_RAW = 32 << 20


class _Table:
    """Ids of pieces by their hash and bytes: open addressing in flat arrays, `most` pieces at most."""

    def __init__(self, most: int, dtype: np.dtype):
        self.most, self.bits = most, (2 * most - 1).bit_length()
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        n = 1 << self.bits
        self.hash = np.zeros(n, np.uint64)
        self.at, self.size, self.raw_at, self.raw_size = (np.zeros(n, np.int32) for _ in range(4))
        self.pool, self.used, self.count = np.zeros(1 << 20, self.dtype), 0, 0
        self.raw, self.raw_used = np.zeros(1 << 20, np.uint8), 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each piece's hash, -1 where it is new."""
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.full(len(hashes), -1, np.int64)
        left = np.arange(len(hashes))
        while len(left):
            s = slot[left]
            k = self.hash[s]
            hit = k == hashes[left]
            out[left[hit]] = s[hit]
            left = left[~hit & (k != 0)]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
        return out

    def same(self, slot: np.ndarray, buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> bool:
        """Whether the pieces, which make up buf, have the bytes of their slots."""
        if not np.array_equal(self.raw_size[slot], lengths):
            return False
        place = np.repeat(self.raw_at[slot] - starts, lengths)
        place += np.arange(len(buf))
        return np.array_equal(self.raw[place], buf)

    @staticmethod
    def _grown(pool: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
        while used + len(more) > len(pool):
            pool = np.concatenate([pool, np.zeros(len(pool), pool.dtype)])
        pool[used : used + len(more)] = more
        return pool

    def add(self, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray, raw: np.ndarray, raw_sizes: np.ndarray) -> None:
        """New pieces of distinct hashes; ids and raw hold theirs one after another."""
        self.pool, self.raw = self._grown(self.pool, self.used, ids), self._grown(self.raw, self.raw_used, raw)
        at, raw_at = self.used + np.cumsum(sizes) - sizes, self.raw_used + np.cumsum(raw_sizes) - raw_sizes
        self.used, self.raw_used, self.count = self.used + len(ids), self.raw_used + len(raw), self.count + len(hashes)
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            s = slot[left]
            free = left[self.hash[s] == 0]
            self.hash[slot[free]] = hashes[free]  # where two want one slot, the last gets it
            won = free[self.hash[slot[free]] == hashes[free]]
            w = slot[won]
            self.at[w], self.size[w], self.raw_at[w], self.raw_size[w] = at[won], sizes[won], raw_at[won], raw_sizes[won]
            done = np.zeros(len(hashes), bool)
            done[won] = True
            left = left[~done[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def ids(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the slots' pieces, and how many each has."""
        sizes = self.size[slot]
        ends = np.cumsum(sizes, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        return self.pool[np.repeat(self.at[slot] - (ends - sizes), sizes) + np.arange(total)], sizes


class Encoder:
    """stream(texts) gives the ids of all texts, one after another, and how many each has. Special tokens' strings count as ordinary text."""

    def __init__(self, path: str, memo: int = 1 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.width = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        made = json.loads(self.tok.to_str())
        pre = made.get("pre_tokenizer") or {}
        self.cuts = made.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and made["model"]["type"] == "BPE" and not made["model"].get("dropout")
        if self.cuts:
            self.memo = _Table(memo, self.dtype)
            self.opens = np.zeros(self.tok.get_vocab_size(), bool)
            for token, i in self.tok.get_vocab().items():
                self.opens[i] = token[:1] in "ĠĊ"  # how the vocabulary writes a space and a newline
            self.tok.model._resize_cache(0)

    def _raw(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.dtype) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, pieces: list[bytes], open_: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids and numbers of ids of pieces; those that open with a space or newline side by side, told apart by it."""
        ids, sizes = [], []
        for i in range(0, len(pieces), 2048):
            some = pieces[i : i + 2048]
            if open_:
                got = self._raw([b"".join(some).decode()])[0]
                starts = np.flatnonzero(self.opens[got])
            if open_ and len(starts) == len(some):
                ids.append(got)
                sizes.append(np.diff(starts, append=len(got)))
            else:
                each = self._raw([p.decode() for p in some])
                ids += each
                sizes.append(np.array([len(x) for x in each]))
        return np.concatenate(ids), np.concatenate(sizes).astype(np.int32)

    def _scanned(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same as stream, for texts in UTF-8 without white space next to white space."""
        joined = b"".join(raw)
        if not joined:
            return np.zeros(0, self.dtype), np.zeros(len(raw), np.int64)
        buf = np.frombuffer(joined, np.uint8)
        begins = np.cumsum([0, *map(len, raw)])
        cut = (buf == 0x20) | (buf == 0x0A)
        cut[begins[:-1][np.diff(begins) > 0]] = True
        starts = np.flatnonzero(cut)
        lengths = np.diff(starts, append=len(buf))
        hashes = run_hashes(buf, starts, lengths) | np.uint64(1)  # 0 marks free slots
        slot = self.memo.find(hashes)
        new = np.flatnonzero(slot < 0)
        if len(new):
            _, first = np.unique(hashes[new], return_index=True)
            if self.memo.count + len(first) > self.memo.most or self.memo.raw_used > _RAW:
                self.memo.clear()
                new = np.arange(len(hashes))
                _, first = np.unique(hashes, return_index=True)
            some = new[first]
            a, b = starts[some].tolist(), (starts + lengths)[some].tolist()
            pieces = [joined[x:y] for x, y in zip(a, b, strict=True)]
            # pieces at a text's start may open with neither; they go by themselves
            opens = np.isin(buf[starts[some]], (0x20, 0x0A))
            for open_ in (True, False):
                k = np.flatnonzero(opens == open_)
                if len(k):
                    mine = [pieces[i] for i in k.tolist()]
                    ids, sizes = self._encoded(mine, open_)
                    self.memo.add(hashes[some[k]], ids, sizes, np.frombuffer(b"".join(mine), np.uint8), lengths[some[k]])
            slot[new] = self.memo.find(hashes[new])
        if not self.memo.same(slot, buf, starts, lengths):  # two pieces have one hash
            each = self._raw([r.decode() for r in raw])
            return np.concatenate(each), np.array([len(x) for x in each])
        ids, sizes = self.memo.ids(slot)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return ids, np.diff(ends[np.searchsorted(starts, begins)])

    def stream(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not self.cuts:
            each = self._raw(texts)
            return np.concatenate([np.zeros(0, self.dtype), *each]), np.array([len(x) for x in each], dtype=np.int64)
        if not any(map(_ODD.search, texts)) and sum(map(len, texts)) <= 4 * _SEGMENT:
            return self._scanned([t.encode() for t in texts])
        each = []
        for t in texts:
            if _ODD.search(t):
                each.append(self._raw([t])[0])
                continue
            raw, parts, at = t.encode(), [np.zeros(0, self.dtype)], 0
            while at < len(raw):
                cut = _CUT.search(raw, min(at + _SEGMENT, len(raw)))
                to = cut.start() if cut else len(raw)
                parts.append(self._scanned([raw[at:to]])[0])
                at = to
            each.append(np.concatenate(parts))
        return np.concatenate([np.zeros(0, self.dtype), *each]), np.array([len(x) for x in each], dtype=np.int64)

    def ids(self, texts: list[str], end: int | None = None) -> list[np.ndarray]:
        """The ids of each text, with the end id after them if there is one."""
        flat, n = self.stream(texts)
        ends = np.cumsum(n)
        if end is not None:
            flat, ends = np.insert(flat, ends, end), ends + np.arange(1, len(ends) + 1)
        return np.split(flat, ends[:-1]) if len(texts) else []


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def slices(batches, most: int = 1 << 20):
    """Lists of (doc_id, text) of about `most` characters, null texts as empty."""
    rows, n = [], 0
    for b in batches:
        for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            t = t.as_py() or ""
            rows.append((d, t))
            n += len(t) + 64
            if n >= most:
                yield rows
                rows, n = [], 0
    if rows:
        yield rows


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")

