"""Token ids of whole texts by a public tokenizer file, repeated words encoded once.

A text is cut before single blanks and around single line ends between two characters that
are no white space, and between an ASCII letter and a sentence mark. At such a place both kinds
of vocabulary (byte-level BPE with leading blanks, BPE with word ends) start a new pre-token
whatever stands around it, so the ids of the parts are the ids of the text. Each worker keeps the ids of the parts it has met in a bounded table, which it
searches by a hash; bytes are compared before ids are taken from it. A part's first 16 bytes are two numbers, so most parts are hashed and compared without
looking at single bytes. Texts with other white space than blanks, tabs and line ends are encoded in one piece.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np

from .bytestext import CHUNK, U, groups, mix, part_hashes

# Parts kept per worker; the table starts anew beyond that.
TABLE_PARTS = 1 << 19
_SLOTS = 1 << 20
# Parts in one call of the tokenizer.
_CALL = 4000
# Bytes of a part that its two numbers hold, and what they have of a part of 0 to 8 bytes.
_SHORT = 16
_HAS = np.array([(1 << 8 * i) - 1 for i in range(9)], U)
# White space that byte tests do not see, and the separator used between parts.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
_SEPARATOR = "\x1f"
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,!?;:")] = True


def _numbers(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first 16 bytes of every part as two numbers, filled up with zeros."""
    words = np.zeros(len(buf) // 8 + 4, "<u8")
    words.view(np.uint8)[: len(buf)] = buf
    at, shift, size = starts >> 3, (starts & 7).astype(U) * U(8), ends - starts
    back = U(63) - shift
    a, b, c = words[at], words[at + 1], words[at + 2]
    first, second = a >> shift | b << back << U(1), b >> shift | c << back << U(1)
    return first & _HAS[np.minimum(size, 8)], second & _HAS[np.clip(size - 8, 0, 8)]


def _number_hashes(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    return mix(first + mix(second + size.astype(U) * U(0xD6E8FEB86659FD93)))


class PartEncoder:
    """``encode_group`` gives the ids of a list of texts, equal to encoding each whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ids = self._ids([f"{_SEPARATOR} a", _SEPARATOR, " a"])
        self.leading = self.tokenizer.id_to_token(int(ids[2][0])).startswith("Ġ")
        tokens = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.is_start = np.array([t.startswith("Ġ") for t in tokens])
        self.is_end = np.array([t.endswith("</w>") for t in tokens])
        self.separator = int(ids[1][0]) if len(ids[1]) == 1 and ids[0][0] == ids[1][0] else None
        self.line_end = int(self._ids(["\n"])[0][0]) if self.leading else None
        self._clear()

    def _clear(self) -> None:
        self.slot = np.full(_SLOTS, -1, np.int32)
        # Of every part its hash, its first two numbers, its size, and where its ids and the bytes behind its numbers start.
        self.keys, self.first, self.second = (np.zeros(TABLE_PARTS, U) for _ in range(3))
        self.size = np.zeros(TABLE_PARTS, np.int64)
        self.start = np.zeros(TABLE_PARTS + 1, np.int64)
        self.byte_at = np.zeros(TABLE_PARTS + 1, np.int64)
        self.flat = np.zeros(1 << 20, np.uint32)
        self.bytes = np.zeros(1 << 16, np.uint8)
        self.n = 0

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _parts_ids(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts and how many each has, in one call where the limits between parts show in the ids."""
        if self.leading and parts[0][0] == " ":
            ids = self._ids(["".join(parts)])[0]
            limits = np.flatnonzero(self.is_start[ids])
            if len(limits) == len(parts) and limits[0] == 0:
                return ids, np.diff(limits, append=len(ids))
        elif self.leading and not any("\n" in p for p in parts):
            ids = self._ids(["\n".join(parts) + "\n"])[0]
            ends = ids == self.line_end
            if ends.sum() == len(parts):
                return ids[~ends], np.diff(np.flatnonzero(ends), prepend=-1) - 1
        elif not self.leading and parts[0].strip(" ").isalpha():
            ids = self._ids([" ".join(parts)])[0]
            ends = np.flatnonzero(self.is_end[ids])
            if len(ends) == len(parts) and ends[-1] == len(ids) - 1:
                return ids, np.diff(ends, prepend=-1)
        elif not self.leading and self.separator is not None:
            ids = self._ids([f" {_SEPARATOR} ".join(parts) + f" {_SEPARATOR}"])[0]
            ends = ids == self.separator
            if ends.sum() == len(parts):
                return ids[~ends], np.diff(np.flatnonzero(ends), prepend=-1) - 1
        each = self._ids(parts)
        return np.concatenate(each), np.array([len(x) for x in each], np.int64)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each hash in the table, -1 if it is not there."""
        out = np.full(len(hashes), -1, np.int64)
        left = np.arange(len(hashes))
        at = (hashes >> U(20)) & U(_SLOTS - 1)
        while len(left):
            slot = self.slot[at]
            hit = (slot >= 0) & (self.keys[slot] == hashes[left])
            out[left[hit]] = slot[hit]
            go = (slot >= 0) & ~hit
            left, at = left[go], (at[go] + U(1)) & U(_SLOTS - 1)
        return out

    def _insert(self, hashes: np.ndarray, first: np.ndarray, second: np.ndarray, parts: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        low, high = self.n, self.n + len(parts)
        self.keys[low:high], self.first[low:high], self.second[low:high] = hashes, first, second
        self.size[low:high] = [len(p) for p in parts]
        rest = np.frombuffer(b"".join(p[_SHORT:] for p in parts), np.uint8)
        ends = np.cumsum(np.maximum(self.size[low:high] - _SHORT, 0)) + self.byte_at[low]
        while ends[-1] > len(self.bytes):
            self.bytes = np.concatenate([self.bytes, np.zeros_like(self.bytes)])
        self.bytes[self.byte_at[low] : ends[-1]] = rest
        self.byte_at[low + 1 : high + 1] = ends
        new = np.cumsum(lengths) + self.start[low]
        while new[-1] > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.start[low] : new[-1]] = ids
        self.start[low + 1 : high + 1] = new
        index = np.arange(low, high, dtype=np.int32)
        self.n = high
        at = (hashes >> U(20)) & U(_SLOTS - 1)
        while len(index):
            free = self.slot[at] < 0
            self.slot[at[free]] = index[free]
            lost = self.slot[at] != index
            index, at = index[lost], (at[lost] + U(1)) & U(_SLOTS - 1)

    def _differ(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, second: np.ndarray, index: np.ndarray) -> np.ndarray:
        """Which parts have other bytes than the table's part of that index; what is behind the numbers is looked at about a megabyte at a time."""
        size = ends - starts
        out = (size != self.size[index]) | (first != self.first[index]) | (second != self.second[index])
        same = np.flatnonzero(~out & (size > _SHORT))
        behind = size[same] - _SHORT
        upto = np.cumsum(behind)
        at = 0
        while at < len(same):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CHUNK, side="right")))
            some, n = same[at:stop], behind[at:stop]
            begin = np.cumsum(n) - n
            flat = np.arange(int(begin[-1] + n[-1]))
            unequal = buf[flat + np.repeat(starts[some] + _SHORT - begin, n)] != self.bytes[flat + np.repeat(self.byte_at[index[some]] - begin, n)]
            out[some] = np.logical_or.reduceat(unequal, begin)
            at = stop
        return out

    def encode_group(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids (uint32) of each text; null is an empty text."""
        odd = [bool(t) and not t.isascii() and _OTHER_SPACE.search(t) is not None or bool(t) and t.isascii() and any(c in t for c in "\x1c\x1d\x1e\x1f") for t in texts]
        plain = [b"" if o or not t else t.encode("utf-8", "surrogatepass") for t, o in zip(texts, odd)]
        done = iter(self._plain(plain))
        for text, o in zip(texts, odd):
            ids = next(done)
            yield self._ids([text])[0] if o else ids

    def _plain(self, texts: list[bytes]) -> list[np.ndarray]:
        lengths = np.array([len(t) for t in texts], np.int64)
        filled = np.flatnonzero(lengths)
        out = [np.zeros(0, np.uint32)] * len(texts)
        if not len(filled):
            return out
        raw = b"".join(texts)
        buf = np.frombuffer(raw, np.uint8)
        at = np.concatenate([[0], np.cumsum(lengths)])
        white = _WHITE[buf]
        cut = np.zeros(len(buf), bool)
        single = ((buf[1:-1] == 0x20) | (buf[1:-1] == 0x0A)) & ~white[:-2] & ~white[2:]
        cut[1:-1] = single
        cut[2:] |= single & (buf[1:-1] == 0x0A)
        cut[1:] |= _MARK[buf[1:]] & _LETTER[buf[:-1]]
        first = at[filled]
        # A blank or line end that begins or ends a text has no neighbour there.
        last = at[filled + 1] - 1
        cut[last[white[last]]] = False
        blank = first[white[first]]
        cut[np.minimum(blank + 1, len(buf) - 1)] = False
        cut[first] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(buf))
        # No stretch has more distinct parts than the table holds.
        found = [self._stretch(raw, buf, starts[i : i + TABLE_PARTS], ends[i : i + TABLE_PARTS]) for i in range(0, len(starts), TABLE_PARTS)]
        ids = np.concatenate([x for x, _ in found])
        upto = np.concatenate([[0], np.cumsum(np.concatenate([x for _, x in found]))])
        limits = upto[np.append(np.searchsorted(starts, first), len(starts))]
        for row, a, b in zip(filled.tolist(), limits[:-1].tolist(), limits[1:].tolist()):
            out[row] = ids[a:b]
        return out

    def _stretch(self, raw: bytes, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of at most TABLE_PARTS consecutive parts and how many each has."""
        first, second = _numbers(buf, starts, ends)
        hashes = _number_hashes(first, second, ends - starts)
        if len(long := np.flatnonzero(ends - starts > _SHORT)):
            hashes[long] = part_hashes(buf, starts[long], ends[long])
        index = self._find(hashes)
        missing = np.flatnonzero(index < 0)
        if len(missing):
            _, one = np.unique(hashes[missing], return_index=True)
            if self.n + len(one) > TABLE_PARTS:
                self._clear()
                index[:] = -1
                _, one = np.unique(hashes, return_index=True)
                missing = np.arange(len(hashes))
            new = missing[one]
            for some in np.array_split(new, max(1, -(-len(new) // _CALL))):
                slices = [raw[s:e] for s, e in zip(starts[some].tolist(), ends[some].tolist())]
                parts = [p.decode("utf-8", "surrogatepass") for p in slices]
                # Parts are encoded together with others whose limits show in the same way.
                kinds = np.array([(p[0] == " ") if self.leading else p.strip(" ").isalpha() for p in parts], np.int8)
                kinds[["\n" in p and k == 0 for p, k in zip(parts, kinds.tolist())]] = 2
                for kind in range(3):
                    if (chosen := kinds == kind).any():
                        picked = np.flatnonzero(chosen).tolist()
                        at = some[chosen]
                        self._insert(hashes[at], first[at], second[at], [slices[i] for i in picked], *self._parts_ids([parts[i] for i in picked]))
            index[missing] = self._find(hashes[missing])
        begin = self.start[index]
        count = self.start[index + 1] - begin
        upto = np.concatenate([[0], np.cumsum(count)])
        ids = self.flat[np.repeat(begin - upto[:-1], count) + np.arange(upto[-1])]
        other = np.flatnonzero(self._differ(buf, starts, ends, first, second, index))
        if len(other):  # parts that share their hash with another one
            each = np.split(ids, upto[1:-1])
            for i in other.tolist():
                each[i] = self._ids([raw[starts[i] : ends[i]].decode("utf-8", "surrogatepass")])[0]
                count[i] = len(each[i])
            ids = np.concatenate(each)
        return ids, count


_encoders: dict[str, PartEncoder] = {}


def encoder(path: str) -> PartEncoder:
    """The worker's encoder for a tokenizer file; it lives as long as the worker."""
    if path not in _encoders:
        _encoders[path] = PartEncoder(path)
    return _encoders[path]


def encode_all(path: str, texts: list[str | None]) -> Iterator[np.ndarray]:
    """Ids of every text, worked on in groups of bounded size."""
    coder, at = encoder(path), 0
    for part in groups([(t or "").encode("utf-8", "surrogatepass") for t in texts]):
        yield from coder.encode_group(texts[at : at + len(part)])
        at += len(part)
