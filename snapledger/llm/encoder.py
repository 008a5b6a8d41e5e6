"""Texts to token ids, with the ids of pieces that were met before kept at hand.

A tokenizer of the byte-level kind first splits a text by a fixed pattern and never merges across a split, so a piece between
two certain splits has the same ids wherever it stands. Texts are cut at places that certainly are splits, many texts at
once; the library encodes the pieces that this worker has not met, and the ids of a text are those of its pieces. Texts that name
an added token, and all texts of other tokenizers, are encoded whole.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from snapledger.llm.common import mix, runs, sums

#: Pieces whose ids a worker keeps; beyond that the ones used longest ago go.
MOST_KEPT = 1_000_000
#: Pieces that are encoded in one call.
PER_CALL = 2_000
LENGTH_FACTOR = np.uint64(0xD6E8FEB86659FD93)

_letters = np.zeros(256, bool)
_letters[65:91] = _letters[97:123] = True
_signs = np.zeros(256, bool)
_signs[33:127] = True
_signs &= ~_letters
_signs[48:58] = _signs[39] = False  # digits, and the apostrophe, which may begin a contraction
_visible = np.zeros(256, bool)
_visible[33:127] = True

_loaded: dict[tuple[str, int], Encoder] = {}


def splits_by_pattern(spec: dict) -> bool:
    """Whether the content of a tokenizer file asks for the pattern that `cuts` follows, and for nothing before it."""
    first = spec.get("pre_tokenizer") or {}
    plain = spec.get("normalizer") is None and first.get("type") == "ByteLevel" and first.get("use_regex", True)
    stripping = any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", ()))
    return plain and not first.get("add_prefix_space") and not stripping and not spec["model"].get("dropout")


def cuts(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where pieces start in the UTF-8 bytes of several texts.

    The splitting pattern always begins anew between a letter and a sign; at a space between two visible characters; and
    before and after a line feed between two. Visible characters and letters are here those of ASCII and of two bytes from U+00C0 to U+023F.
    """
    n = len(raw)
    lead = (raw >= 0xC3) & (raw <= 0xC8)
    second = np.zeros(n, bool)
    second[1:] = lead[:-1]
    # the signs of multiplication and division are the only ones among them
    other = np.zeros(n, bool)
    other[:-1] = (raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))
    begins = _letters[raw] | lead & ~other
    ends = _letters[raw] | second
    ends[1:] &= ~other[:-1]
    sign, seen = _signs[raw], _visible[raw]
    after, before = np.zeros(n, bool), np.zeros(n, bool)  # whether a visible character follows, comes before
    after[:-1] = (seen | lead)[1:]
    before[1:] = (seen | second)[:-1]
    filled = bounds[:-1][np.diff(bounds) > 0]
    before[filled] = False
    after[bounds[1:][np.diff(bounds) > 0] - 1] = False
    lone = before & after
    feed = lone & (raw == 10)
    cut = lone & (raw == 32) | feed
    cut[1:] |= feed[:-1] | ends[:-1] & sign[1:] | sign[:-1] & begins[1:]
    cut[filled] = True
    return np.flatnonzero(cut)


class Encoder:
    """Token ids of texts, with an end id after each."""

    def __init__(self, path: str, end: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), end
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.by_piece = splits_by_pattern(spec)
        self.added = [t["content"] for t in spec.get("added_tokens", ())]
        largest = max([end, *self.tokenizer.get_vocab(with_added_tokens=True).values()])
        self.id_bytes = 2 if largest < 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.id_bytes}")
        self.clock = 0
        # known pieces in order of their hash: hash, first bytes, length, place of their ids, number of ids, last use
        self.hash, self.head = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.length, self.place, self.count, self.used = (np.empty(0, np.int64) for _ in range(4))
        self.ids = np.empty(0, self.kind)

    @classmethod
    def loaded(cls, path: str, end: int) -> Encoder:
        """The encoder of this worker process, which keeps the pieces met in earlier tasks."""
        if (path, end) not in _loaded:
            _loaded[path, end] = cls(path, end)
        return _loaded[path, end]

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number of each text, the end id included."""
        found = [np.array([*e.ids, self.end], self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate(found), np.array([len(f) for f in found], np.int64)

    def encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts, one after the other, and their number of each text; a null text is empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not self.by_piece:
            return self.whole(texts.to_pylist())
        named = np.zeros(len(texts), bool)
        for token in self.added:
            named |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        ids, counts, sure = self.pieced(raw, bounds - bounds[0])
        if (apart := np.flatnonzero(named | ~sure)).size:
            each = np.split(ids, np.cumsum(counts)[:-1])
            for i, text in zip(apart.tolist(), texts.take(pa.array(apart)).to_pylist()):
                each[i], counts[i : i + 1] = self.whole([text])
            ids = np.concatenate(each)
        return ids, counts

    def pieced(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, their number of each text, and whether every piece of a text was told apart from all others."""
        start = cuts(raw, bounds) if len(raw) else np.empty(0, np.int64)
        end = np.append(start[1:], len(raw))[: len(start)]
        length = end - start
        hashed = mix(runs(sums(raw.astype(np.uint64) + np.uint64(1)), start, end) + length.astype(np.uint64) * LENGTH_FACTOR)
        padded = np.concatenate([raw, np.zeros(8, np.uint8)])
        head = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))[start]
        head = head & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * np.clip(length, 1, 8).astype(np.uint64)))
        unique, first, which = np.unique(hashed, return_index=True, return_inverse=True)
        at = self.found(unique, first, raw, start, end, head)[which]
        sure = (self.head[at] == head) & (self.length[at] == length)
        count = self.count[at]
        place = np.repeat(self.place[at] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        # one end id after each text
        piece = np.searchsorted(start, bounds)
        before = np.concatenate([[0], np.cumsum(count)])[piece]
        out = np.insert(self.ids[place], before[1:], self.end)
        unsure = np.concatenate([[0], np.cumsum(~sure)])[piece]
        return out, np.diff(before) + 1, np.diff(unsure) == 0

    def found(self, hashes, first, raw, start, end, head) -> np.ndarray:
        """Place of each hash among the known pieces, after the new ones among them are encoded."""
        self.clock += 1
        at = np.searchsorted(self.hash, hashes)
        known = np.zeros(len(hashes), bool)
        inside = at < len(self.hash)
        known[inside] = self.hash[at[inside]] == hashes[inside]
        self.used[at[known]] = self.clock
        if known.all():
            return at
        if len(self.hash) and len(self.hash) + int((~known).sum()) > MOST_KEPT:
            self.forget()
        new, data = first[~known], raw.tobytes()
        texts = [data[a:b].decode() for a, b in zip(start[new].tolist(), end[new].tolist())]
        ids, counts = [self.ids], []
        for k in range(0, len(texts), PER_CALL):
            part = texts[k : k + PER_CALL]
            encoding = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(encoding.ids, self.kind))
            counts.append(np.bincount(np.array(encoding.word_ids, np.int64), minlength=len(part)))
        count = np.concatenate(counts)
        place = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate(ids)
        columns = (hashes[~known], head[new], (end - start)[new], place, count, np.full(len(new), self.clock))
        mine = (self.hash, self.head, self.length, self.place, self.count, self.used)
        joined = [np.concatenate(pair) for pair in zip(mine, columns)]
        order = np.argsort(joined[0], kind="stable")
        self.hash, self.head, self.length, self.place, self.count, self.used = (c[order] for c in joined)
        return np.searchsorted(self.hash, hashes)

    def forget(self) -> None:
        """Keep the half of the pieces that was used last, and those of the current texts."""
        kept = self.used >= min(self.clock, int(np.median(self.used)) + 1)
        count, place = self.count[kept], self.place[kept]
        moved = np.cumsum(count) - count
        self.ids = self.ids[np.repeat(place - moved, count) + np.arange(count.sum())]
        self.hash, self.head, self.length, self.used = (c[kept] for c in (self.hash, self.head, self.length, self.used))
        self.count, self.place = count, moved
