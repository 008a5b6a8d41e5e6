"""A compressed full-text index over words: BWT in a wavelet matrix, searched backwards.

One index holds the passages of one shard, a bounded number of words, and the document of each. All queries of the shard are
searched together, one word of each per step. The suffixes that begin with what is matched are an interval of the index, and the
smallest document among them tells whether a document before the query's holds it.
"""

from __future__ import annotations

import numpy as np

#: Words of a query that are searched in one go.
PIECE = 320


class Bits:
    """A bit vector with constant-time rank: 64 bits to a word, and the ones before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        padded = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        padded[: len(packed)] = packed
        self.words = padded.view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32)])[:-1].astype(np.int32)
        self.zeros = int(len(bits) - bits.sum())

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones in the first i bits."""
        word = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below).astype(np.int64)


class WaveletMatrix:
    """Rank of any symbol in a sequence of small integers, one bit vector per bit of the symbols."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.levels = max(1, int(alphabet - 1).bit_length())
        self.bits = []
        for level in reversed(range(self.levels)):
            bit = (symbols >> level & 1).astype(bool)
            self.bits.append(Bits(bit))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        # where the run of each symbol starts in the last order
        self.start = self.descend(np.arange(alphabet), np.zeros(alphabet, np.int64))

    def descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, bits in zip(reversed(range(self.levels)), self.bits):
            ones = bits.ones(i)
            i = np.where(symbol >> level & 1, bits.zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the first i places."""
        return self.descend(symbol, i) - self.start[symbol]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a text whose separators are all different, by doubling the compared length."""
    _, rank = np.unique(text, return_inverse=True)
    n, width = len(text), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        step = np.ones(n, np.int64)
        step[0], step[1:] = 0, key[order][1:] != key[order][:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        if rank[order[-1]] == n - 1 or width >= n:
            return order
        width *= 2


class Least:
    """Smallest value of any interval of an array, by tables of the smallest of 1, 2, 4, … neighbours."""

    def __init__(self, values: np.ndarray):
        self.tables = [values]
        while 1 << len(self.tables) <= len(values):
            last, step = self.tables[-1], 1 << (len(self.tables) - 1)
            self.tables.append(np.minimum(last[:-step], last[step:]))

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Smallest of values[low:high], for intervals that are not empty."""
        out = np.empty(len(low), self.tables[0].dtype)
        size = np.frexp(high - low)[1] - 1
        for k in np.unique(size):
            at = np.flatnonzero(size == k)
            out[at] = np.minimum(self.tables[k][low[at]], self.tables[k][high[at] - (1 << k)])
        return out


class WordIndex:
    """Index of passages, each an array of word hashes, with the document of each."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray, documents: np.ndarray):
        self.vocabulary, symbol = np.unique(words, return_inverse=True)
        # every passage is followed by a separator of its own, smaller than all words
        ends = np.cumsum(lengths + 1) - 1
        text = np.empty(len(words) + len(lengths), np.int64)
        text[ends] = np.arange(len(lengths))
        inside = np.ones(len(text), bool)
        inside[ends] = False
        text[inside] = symbol + len(lengths)
        self.separators, self.size = len(lengths), len(text)
        alphabet = len(self.vocabulary) + len(lengths)
        order = suffix_array(text)
        bwt = text[order - 1]
        self.documents = Least(np.repeat(documents, lengths + 1)[order])
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet))])[:-1]
        self.matrix = WaveletMatrix(bwt, alphabet)

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """Symbol of each word, -1 if no passage holds it."""
        at = np.minimum(np.searchsorted(self.vocabulary, words), max(0, len(self.vocabulary) - 1))
        return np.where(self.vocabulary[at] == words, at + self.separators, -1)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals after putting a word before what was matched; empty for unknown words."""
        known, n = np.maximum(symbol, 0), len(symbol)
        both = self.smaller[np.tile(known, 2)] + self.matrix.rank(np.tile(known, 2), np.concatenate([low, high]))
        return np.where(symbol >= 0, both[:n], 0), np.where(symbol >= 0, both[n:], 0)

    def matches(
        self, words: np.ndarray, lengths: np.ndarray, documents: np.ndarray, least: int
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, start, end) of stretches of at least `least` words that stand in a document before the query's.

        Every such stretch lies in one that is reported. Each query is matched from its right end to the left as long as
        the smallest document with the match is smaller than the query's, which can only grow with the match. Where this ends, at
        word i, longer matches over word i - 1 must end before i + least, so the search goes on from there.
        """
        symbol = self.symbols(words)
        start = np.concatenate([[0], np.cumsum(lengths)])[:-1].astype(np.int64)
        # long queries are searched in pieces that overlap by least - 1 words, so that all finish in few steps
        step = PIECE - least + 1
        pieces = np.maximum(0, -(-(lengths - least + 1) // step))
        query = np.repeat(np.arange(len(lengths)), pieces)
        nth = np.arange(len(query)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = start[query] + nth * step
        end = np.minimum(begin + PIECE, (start + lengths)[query])
        at = end.copy()
        low, high = np.zeros(len(query), np.int64), np.full(len(query), self.size, np.int64)
        found = []
        while len(query):
            nlow, nhigh = self.extend(symbol[at - 1], low, high)
            grown = nlow < nhigh
            held = np.flatnonzero(grown)
            grown[held] = self.documents.of(nlow[held], nhigh[held]) < documents[query[held]]
            at, low, high = np.where(grown, at - 1, at), np.where(grown, nlow, 0), np.where(grown, nhigh, self.size)
            stop = ~grown | (at == begin)
            hit = np.flatnonzero(stop & (end - at >= least))
            if len(hit):
                found.append((query[hit], at[hit] - start[query[hit]], end[hit] - start[query[hit]]))
            # a match that reached the start of its query is finished with it
            end = np.where(stop, np.where(grown, begin, np.minimum(end - 1, at + least - 1)), end)
            at = np.where(stop, end, at)
            low, high = np.where(stop, 0, low), np.where(stop, self.size, high)
            going = end - begin >= least
            query, begin, end, at, low, high = (x[going] for x in (query, begin, end, at, low, high))
        if not found:
            return (np.empty(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found))
