"""Token ids of a byte-level BPE tokenizer file, with one encoding for each distinct word.

Texts are cut into the words of the tokenizer's own pattern by array operations over their code
points; a cache has the ids of words seen before, and only new words are encoded. The cache is looked
up by hashes, and every hit is compared with the word itself: words that only share a hash, and words
of more than 64 characters, are encoded each time. Results are those of
``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``; texts that hold an added token's
own string go through that call.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from tokenizers import Tokenizer

from verdigrain.llm import textvec
from verdigrain.llm.shared import buffers, slices

_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
# The code points with Unicode's White_Space property, and the pattern of the words.
_SPACES = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of each code point, by its Unicode category."""
    kinds = {"L": _LETTER, "N": _NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[_SPACES] = _SPACE
    return table


def _bytes_of_chars() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def word_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the pattern's words begin, given each text's first position (texts aren't empty)."""
    n = len(points)
    kind = _classes()[points]
    head = np.zeros(n, bool)
    head[first] = True
    before = np.empty(n, np.uint8)
    before[0], before[1:] = 255, kind[:-1]
    before[first] = 255
    start = head | (kind != before)
    # of white space before a word, the last character stands alone, or joins the word if it is a blank
    last_space = np.zeros(n, bool)
    last_space[:-1] = (kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~head[1:]
    start |= last_space
    joins = np.zeros(n, bool)
    joins[1:] = last_space[:-1] & (points[:-1] == 32)
    start &= ~joins
    # contractions count where their apostrophe begins a word
    for at in np.flatnonzero(start & (points == 39)).tolist():
        for tail in ((115,), (116,), (114, 101), (118, 101), (109,), (108, 108), (100,)):
            end = at + 1 + len(tail)
            if end <= n and tuple(points[at + 1 : end].tolist()) == tail and not head[at + 1 : end].any():
                start[at + 1 : end] = False
                if end < n:
                    start[end] = True
                    # what follows begins anew: a blank before a word still joins it
                break
    return np.flatnonzero(start)


#: Words of more characters aren't kept.
LONGEST = 64


class _Pool:
    """A growing array to which spans are added."""

    def __init__(self) -> None:
        self.data, self.used = np.zeros(1 << 16, np.uint32), 0

    def add(self, values: np.ndarray) -> int:
        while self.used + len(values) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        self.data[self.used : self.used + len(values)] = values
        self.used += len(values)
        return self.used - len(values)


class WordCachedTokenizer:
    """most: distinct words to keep; when there are more, the cache begins anew."""

    @staticmethod
    @lru_cache(2)
    def of(path: str) -> "WordCachedTokenizer":
        return WordCachedTokenizer(path)

    def __init__(self, path: str, most: int = 400_000) -> None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        chars = _bytes_of_chars()
        added = {x["content"]: x["id"] for x in model.get("added_tokens", ())}
        vocabulary = model["model"]["vocab"]
        ranks = {bytes(chars[c] for c in word): number for word, number in vocabulary.items() if word not in added}
        #: the bytes of each id
        self.sizes = np.zeros(max([*vocabulary.values(), *added.values()]) + 1, np.int64)
        for word, number in (*ranks.items(), *((x.encode(), number) for x, number in added.items())):
            self.sizes[number] = len(word)
        self.path, self._exact = path, None
        self.added = sorted(x.encode() for x in added)
        self.words = tiktoken.Encoding("words", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.most = most
        self.forget()

    @property
    def exact(self) -> Tokenizer:
        """Loaded only once a text holds an added token: it is large, and each worker has its own."""
        if self._exact is None:
            self._exact = Tokenizer.from_file(self.path)
        return self._exact

    def forget(self) -> None:
        """Begin anew. Of each known word, in the order of hashes: where its characters and its ids are."""
        self.hashes = np.zeros(0, np.uint64)
        self.places = np.zeros((0, 4), np.int32)  # characters' start and number, ids' start and number
        self.chars, self.ids = _Pool(), _Pool()

    def _learn(self, whole: str, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> None:
        if len(self.hashes) + len(hashes) > self.most:
            self.forget()
        ids = [self.words.encode_ordinary(whole[a : a + n]) for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        own = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        chars = self.chars.add(points[own]) + np.cumsum(sizes) - sizes
        first = self.ids.add(np.fromiter((x for y in ids for x in y), np.uint32, int(counts.sum()))) + np.cumsum(counts) - counts
        order = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, order, hashes)
        self.places = np.insert(self.places, order, np.stack([chars, sizes, first, counts], 1).astype(np.int32), 0)

    def _known(self, hashes: np.ndarray) -> np.ndarray:
        """The number of the word of each hash, or -1."""
        found = np.searchsorted(self.hashes, hashes)
        inner = found < len(self.hashes)
        found[inner] = np.where(self.hashes[found[inner]] == hashes[inner], found[inner], -1)
        return np.where(inner, found, -1)

    def _words(self, whole: str, points: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after the other, and how many each has; more distinct words than the cache holds go in runs of words."""
        size = ends - starts
        alone = size > LONGEST
        rows = np.flatnonzero(~alone)
        distinct, one, which = np.unique(hashes[rows], return_index=True, return_inverse=True)
        if len(distinct) > self.most:
            runs = [self._words(whole, points, *(x[k : k + self.most] for x in (starts, ends, hashes))) for k in range(0, len(starts), self.most)]
            return np.concatenate([ids for ids, _ in runs]), np.concatenate([n for _, n in runs])
        first = rows[one]
        known = self._known(distinct)
        if len(self.hashes) + int((known < 0).sum()) > self.most:
            self.forget()
            known[:] = -1
        new = first[known < 0]
        if len(new):
            self._learn(whole, points, starts[new], size[new], hashes[new])
            known = self._known(distinct)
        # a word is the cached one only if its characters are the same
        place = self.places[known[which]].astype(np.int64)
        same = size[rows] == place[:, 1]
        same[same] = textvec.same_spans(points, starts[rows[same]], self.chars.data, place[same, 0], size[rows[same]])
        alone[rows[~same]] = True
        counts = np.zeros(len(starts), np.int64)
        counts[rows[same]] = place[same, 3]
        singly = {k: self.words.encode_ordinary(whole[a:b]) for k, a, b in zip(np.flatnonzero(alone).tolist(), starts[alone].tolist(), ends[alone].tolist(), strict=True)}
        for k, ids in singly.items():
            counts[k] = len(ids)
        stop = np.cumsum(counts)
        out = np.empty(int(stop[-1]), np.uint32)
        each, begin = counts[rows[same]], stop[rows[same]] - counts[rows[same]]
        inner = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        out[np.repeat(begin, each) + inner] = self.ids.data[np.repeat(place[same, 2], each) + inner]
        for k, ids in singly.items():
            out[stop[k] - counts[k] : stop[k]] = ids
        return out, counts

    def encoded(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text; null counts as empty."""
        data, offsets = buffers(column)
        for i, j in slices(offsets, 1 << 18):
            yield from self._slice(data[offsets[i] : offsets[j]].tobytes(), offsets[i : j + 1] - offsets[i])

    def _slice(self, data: bytes, offsets: np.ndarray) -> Iterator[np.ndarray]:
        rows = len(offsets) - 1
        special = set()
        if any(x in data for x in self.added):
            special = {k for k in range(rows) if any(x in data[offsets[k] : offsets[k + 1]] for x in self.added)}
        whole = data.decode()
        points = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        if not len(points):
            yield from (np.zeros(0, np.uint32) for _ in range(rows))
            return
        # code points begin at bytes that don't continue another
        lead = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
        at = np.concatenate([[0], np.cumsum(lead)])[offsets]
        starts = word_starts(points, np.unique(at[:-1][at[:-1] < at[1:]]))
        ends = np.append(starts[1:], len(points))
        hashes = textvec.span_hashes(points, starts, ends)
        ids, size = self._words(whole, points, starts, ends, hashes)
        stop = np.cumsum(size)
        edge = np.concatenate([[0], stop])[np.searchsorted(starts, at)]
        for k in range(rows):
            if k in special:
                yield np.array(self.exact.encode(data[offsets[k] : offsets[k + 1]].decode(), add_special_tokens=False).ids, np.uint32)
            else:
                yield ids[edge[k] : edge[k + 1]]
