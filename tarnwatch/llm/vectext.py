"""Words, substrings and their hashes for many texts at once, with numpy over UTF-8 bytes.

A polynomial hash modulo 2**64 over the whole chunk gives the hash of any substring in constant time, so no Python
loop runs over words. Chunks hold whole texts, so a word never crosses a border; one text larger than a chunk is a
chunk of its own.
"""

import numpy as np

CHUNK = 1 << 19
U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
STOP = np.zeros(256, bool)
STOP[[*b".!?\n"]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def powers(n: int):
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK + 4096)
        _powers["up"], _powers["down"] = (np.cumprod(np.concatenate(([U(1)], np.full(size - 1, b)))) for b in (BASE, INVERSE))
    return _powers["up"][:n], _powers["down"][:n]


def mix(h):
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(29))) * U(0xA0761D6478BD642F)
    return h ^ (h >> U(32))


def chunks(texts):
    """Lists of positions whose texts together hold about CHUNK bytes, with those texts as bytes."""
    own, data, size = [], [], 0
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""
        if own and size + len(b) > CHUNK:
            yield own, data
            own, data, size = [], [], 0
        own.append(i)
        data.append(b)
        size += len(b)
    if own:
        yield own, data


class Chunk:
    """Words of a chunk of texts: start, end, doc (all aligned); of(): hashes of substrings."""

    def __init__(self, data: list, apart, lower: bool = False):
        """apart: a 256-entry mask of the bytes that end a word."""
        joined = np.frombuffer(b"\n".join([*data, b""]), np.uint8)
        self.raw = joined
        self.bytes = LOWER[joined] if lower else joined
        self.docs = len(data)
        sizes = np.fromiter((len(b) + 1 for b in data), np.int64, len(data))
        self.ends = np.cumsum(sizes)
        inside = ~apart[joined]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        self.doc = np.searchsorted(self.ends, self.start, "right")
        up, self.down = powers(len(joined) + 1)
        self.sums = np.concatenate(([U(0)], np.cumsum((self.bytes.astype(U) + U(1)) * up[:-1])))

    def of(self, start, end):
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def words(self):
        return self.of(self.start, self.end)


def ngrams(chunk: Chunk, start, end, sizes, prefixes):
    """(hash, index of word) of whole words, prefixes and inner n-grams of the given words, by characters of UTF-8."""
    # a character begins at every byte but those that go on with one
    at = np.append(np.flatnonzero((chunk.bytes & 0xC0) != 0x80), len(chunk.bytes))
    first, last = np.searchsorted(at, start), np.searchsorted(at, end)
    n, k = last - first, np.arange(len(start))
    hashes, owner = [chunk.of(start, end)], [k]
    for size in prefixes:
        m = n >= size
        hashes.append(mix(chunk.of(start[m], at[first[m] + size]) + U(1000 + size)))
        owner.append(k[m])
    for size in sizes:
        count = np.maximum(n - size + 1, 0)
        of = np.repeat(k, count)
        c = first[of] + (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count))
        hashes.append(mix(chunk.of(at[c], at[c + size]) + U(2000 + size)))
        owner.append(of)
    return np.concatenate(hashes), np.concatenate(owner)
