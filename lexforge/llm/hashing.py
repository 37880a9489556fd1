"""Vectorised hashes. Words get a keyed 64-bit hash; where a wrong word would be a wrong result (Pool), their bytes
are compared as well. Polynomial hashes of byte stretches only serve to choose places."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Key of the words' hash: 16 bytes.
HASH_KEY = "lexforge.words.1"
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix)."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, for i up to n."""
    size = (int(n) // (1 << 18) + 1) << 18
    if size not in _powers:
        _powers.clear()
        up, down = np.full(size, BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers[size] = np.cumprod(up), np.cumprod(down)
    return _powers[size]


def sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash over bytes."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def hashes(total: np.ndarray, start: np.ndarray, length) -> np.ndarray:
    """Hashes of the strings that begin at start, from sums()."""
    _, down = powers(len(total))
    return mix((total[start + length] - total[start]) * down[start])


def pack6(x: np.ndarray) -> bytes:
    """The six lower bytes of each number."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack6(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def hash_strings(strings: pa.Array) -> np.ndarray:
    """A keyed 64-bit hash (SipHash) of every string of a large_string array without nulls."""
    out = np.empty(len(strings), np.uint64)
    for a in range(0, len(strings), 1 << 17):  # pieces, so that few strings are Python objects at a time
        part = strings.slice(a, 1 << 17).to_numpy(zero_copy_only=False)
        out[a : a + len(part)] = pd.util.hash_array(part, hash_key=HASH_KEY, categorize=False)
    return out


def string_bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings of a large_string array one after another, and each one's length."""
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, np.int64)
    some = data is not None and at[-1] > at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if some else np.zeros(0, np.uint8), np.diff(at)


def gather(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places begin, begin + 1, ... of every stretch, one after another."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of all texts, lower-cased in ASCII; the distinct word of each word; and where each text's
    words end. A null text has none."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    offsets = split.offsets.to_numpy().astype(np.int64)
    # not of a slice: that garbles offsets
    flat = pc.ascii_lower(split.values).slice(offsets[0], offsets[-1] - offsets[0])
    # leading and trailing white space gives empty strings
    keep = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(keep)])[offsets - offsets[0]][1:]
    coded = flat.filter(pa.array(keep)).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), ends


class Pool:
    """Ids and a value of every known word; all is forgotten beyond a number of words. Words are found by their hash,
    then told apart by their bytes: one whose hash another word holds is made anew each time."""

    def __init__(self, most: int):
        self.most = most
        self.forget()

    def forget(self) -> None:
        none = np.zeros(0, np.int64)
        self.hash, self.slot = np.zeros(0, np.uint64), none  # sorted; the slot of each
        self.at, self.size, self.value = none, none, np.zeros(0)
        self.text_at, self.text_size = none, none
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.text, self.text_used = np.zeros(1 << 18, np.uint8), 0

    def _add_ids(self, raw: list[bytes] | tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(raw, tuple):
            ids, size = raw
        else:
            size = np.fromiter((len(b) // 4 for b in raw), np.int64, len(raw))
            ids = np.frombuffer(b"".join(raw), "<u4")
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        begin = self.used + np.cumsum(size) - size
        self.used += len(ids)
        return begin, size

    def _learn(self, h: np.ndarray, words: pa.Array, make, arrays: bool) -> None:
        raw, value = make(words if arrays else words.to_pylist())
        begin, size = self._add_ids(raw)
        data, lens = string_bytes(words)
        while self.text_used + len(data) > len(self.text):
            self.text = np.concatenate([self.text, np.zeros_like(self.text)])
        self.text[self.text_used : self.text_used + len(data)] = data
        slot = len(self.at) + np.arange(len(h))
        self.at, self.size, self.value = np.append(self.at, begin), np.append(self.size, size), np.append(self.value, np.broadcast_to(value, len(h)))
        self.text_at, self.text_size = np.append(self.text_at, self.text_used + np.cumsum(lens) - lens), np.append(self.text_size, lens)
        self.text_used += len(data)
        place = np.searchsorted(self.hash, h)
        self.hash, self.slot = np.insert(self.hash, place, h), np.insert(self.slot, place, slot)

    def find(self, words: pa.Array, make, arrays: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash of each distinct word, where its ids begin in self.ids, how many they are, and its value.
        make(list of words): for each new one its ids as little-endian 32-bit bytes, and its value. arrays: make takes an
        Arrow array, and gives all ids one after another and how many each word has in place of the bytes."""
        h = hash_strings(words)
        if len(self.hash) + len(h) > self.most:
            self.forget()
        order = np.argsort(h, kind="stable")
        q = h[order]
        place = np.searchsorted(self.hash, q)
        there = self.hash[np.minimum(place, len(self.hash) - 1)] == q if len(self.hash) else np.zeros(len(q), bool)
        there[1:] |= q[1:] == q[:-1]  # the first of equal hashes is learnt
        miss = np.flatnonzero(~there)
        if len(miss):
            self._learn(q[miss], words.take(pa.array(order[miss])), make, arrays)
        slot = self.slot[np.searchsorted(self.hash, h)] if len(h) else np.zeros(0, np.int64)
        at, size, value = self.at[slot], self.size[slot], self.value[slot]
        data, lens = string_bytes(words)
        odd = self.text_size[slot] != lens
        n = np.where(odd, 0, lens)
        begin = np.cumsum(lens) - lens
        wrong = self.text[gather(self.text_at[slot], n)] != data[gather(begin, n)]
        if wrong.any():
            odd[np.repeat(np.arange(len(n)), n)[wrong]] = True
        if odd.any():
            other = np.flatnonzero(odd)
            again = words.take(pa.array(other))
            raw, own = make(again if arrays else again.to_pylist())
            at[other], size[other] = self._add_ids(raw)
            value[other] = own
        return h, at, size, value
