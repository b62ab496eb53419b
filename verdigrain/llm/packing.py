"""Packing by a dot-product heuristic for vector bins.

Every document becomes its token ids and an end id, cut where a sequence is full. A bin has three
limits at once: tokens, segments (pieces) and loss-bearing tokens (those that a document's mask names;
all of them where it has none). Among waiting items, the one is placed whose demand has the largest dot
product with what the bin has left, each dimension weighted by its mean demand; an item that doesn't
fit whole may be cut to fill the bin. What remains at the end of a partition is dealt to bins whose
sizes are powers of two, so that it needs no padding.

A task packs the rows of its own input split, in order, with a bounded pool of waiting items: there
is no shuffle, and a lost task is packed anew in the same way. Sequence numbers hold the partition's
number in their upper bits.

What bears loss is told by a column of masks, or by a marker: with ``prompt_end``, all up to and with
the first such string is a prompt, whose tokens bear none.

Null and empty texts have only the end id. Repeated rows are packed each. Of items with equal scores,
the one that has waited at the lowest place goes first. A text of any length is cut into pieces of one
bin each; its ids are held while its last piece waits. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from verdigrain.llm.shared import released
from verdigrain.llm.tokens import WordCachedTokenizer
from verdigrain.session import on_workers

END_ID = 1
PARTITION_SHIFT = 33


class VectorBins:
    """Packs (key, size) items into bins; pieces() gives what is packed so far.

    limits: tokens, segments, loss-bearing tokens. pool: items that may wait for a bin.
    """

    def __init__(self, limits: tuple[int, int, int], pool: int) -> None:
        if min(limits) < 1:
            raise ValueError("limits must be positive")
        self.limits, self.pool = np.array(limits, np.float64), pool
        self.keys = np.zeros(pool, np.int64)
        self.starts = np.zeros(pool, np.int64)
        self.sizes = np.zeros(pool, np.int64)
        self.losses = np.zeros(pool, np.int64)
        self.before: dict[int, np.ndarray] = {}
        self.n = 0
        self.bins = 0
        self.out: list[tuple[int, int, int, int, int]] = []

    def add(self, key: int, size: int, mask: np.ndarray | None = None) -> None:
        """What no bin holds whole is cut off at once in bins of its own; the rest waits. mask: which tokens bear loss (all, if None)."""
        most, most_loss, start = int(self.limits[0]), int(self.limits[2]), 0
        if mask is not None:
            self.before[key] = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        while size - start >= most or self._loss(key, start, size - start) > most_loss:
            length = self._length(key, start, min(size - start, most), most_loss)
            self.out.append((key, start, length, self.bins, 0))
            self.bins += 1
            start += length
        if start < size:
            self.keys[self.n], self.starts[self.n], self.sizes[self.n], self.losses[self.n] = key, start, size - start, self._loss(key, start, size - start)
            self.n += 1
        else:
            self.before.pop(key, None)
        if self.n == self.pool:
            while self.n > self.pool // 2:
                self._fill(most)

    def _loss(self, key: int, start: int, length: int) -> int:
        """Loss-bearing tokens of a piece."""
        before = self.before.get(key)
        return length if before is None else int(before[start + length] - before[start])

    def _length(self, key: int, start: int, most: int, loss: int) -> int:
        """Tokens from `start`, at most `most`, with at most `loss` loss-bearing ones."""
        before = self.before.get(key)
        if before is None:
            return min(most, loss)
        return min(most, int(np.searchsorted(before, before[start] + loss, side="right")) - 1 - start)

    def finish(self) -> None:
        """Deal out what waits: whole bins first, then one bin for each power of two in the rest."""
        most = int(self.limits[0])
        while self.n:
            rest = int(self.sizes[: self.n].sum())
            self._fill(most if rest >= most else 1 << (rest.bit_length() - 1))

    def pieces(self) -> list[tuple[int, int, int, int, int]]:
        """(key, start, length, bin, offset) since the last call."""
        out, self.out = self.out, []
        return out

    def _fill(self, size: int) -> None:
        """Pack one bin of at most `size` tokens."""
        left = self.limits.copy()
        left[0], at = size, 0
        while self.n and left[0] >= 1 and left[1] >= 1:
            sizes, losses = self.sizes[: self.n], self.losses[: self.n]
            weights = np.array([float(sizes.mean()), 1.0, float(losses.mean())]) / self.limits
            left_share = left / self.limits
            score = weights[0] * left_share[0] * sizes / self.limits[0] + weights[1] * left_share[1] / self.limits[1] + weights[2] * left_share[2] * losses / self.limits[2]
            fits = (sizes <= left[0]) & (losses <= left[2])
            if fits.any():
                k = int(np.argmax(np.where(fits, score, -1.0)))
                length = int(sizes[k])
            else:
                # the smallest item that has something for this bin
                for k in np.argsort(sizes, kind="stable").tolist():
                    length = self._length(int(self.keys[k]), int(self.starts[k]), int(min(sizes[k], left[0])), int(left[2]))
                    if length >= 1:
                        break
                else:
                    break
            key, start = int(self.keys[k]), int(self.starts[k])
            loss = self._loss(key, start, length)
            self.out.append((key, start, length, self.bins, at))
            at += length
            left -= (length, 1, loss)
            if length == sizes[k]:
                self.n -= 1
                self.before.pop(key, None)
                for x in (self.keys, self.starts, self.sizes, self.losses):
                    x[k] = x[self.n]
            else:
                self.starts[k] += length
                self.sizes[k] -= length
                self.losses[k] -= loss
        self.bins += 1


def pack(
    df: DataFrame, *, tokenizer_file: str, id_column: str = "doc_id", text_column: str = "text", max_tokens: int = 2048, max_segments: int = 256, max_loss_tokens: int | None = None, loss_column: str | None = None, prompt_end: str | None = None, end_id: int = END_ID, pool: int = 512, with_ids: bool = False,
) -> DataFrame:
    """Packed pieces: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    The waiting items keep their ids in memory: at most `pool` times `max_tokens` of them.
    loss_column: array<boolean>, whether each token of the text bears loss; where it is null, and for
    tokens after its end (such as the end id), all do. prompt_end: tokens that begin before the end of
    this string's first place bear none; a text without it has no prompt. max_loss_tokens: as many as
    tokens, if None.
    """
    if loss_column is not None and prompt_end is not None:
        raise ValueError("a mask and a marker can't both say what bears loss")
    marker = (prompt_end or "").encode()
    on_workers(df.sparkSession)
    limits = (max_tokens, max_segments, max_tokens if max_loss_tokens is None else max_loss_tokens)
    names = [id_column, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    id_type = dict(df.dtypes)[id_column]

    def masked(flags: list[bool] | None, size: int) -> np.ndarray | None:
        if flags is None:
            return None
        if len(flags) > size:
            raise ValueError("a loss mask is longer than its text's tokens")
        return np.concatenate([np.array(flags, bool), np.ones(size - len(flags), bool)])

    def after_prompt(text: str | None, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray | None:
        end = (text or "").encode().find(marker)
        if end < 0:
            return None
        # the end id has no bytes and comes last
        lengths = np.append(sizes[ids[:-1]], 0)
        return np.cumsum(lengths) - lengths >= end + len(marker)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordCachedTokenizer.of(tokenizer_file)
        bins, held, key = VectorBins(limits, pool), {}, 0
        first = TaskContext.get().partitionId() << PARTITION_SHIFT

        def told(kind: pa.DataType) -> pa.RecordBatch:
            rows: list[list] = [[] for _ in names]
            for k, start, length, number, offset in bins.pieces():
                entry = held[k]
                ids = entry[1][start : start + length]
                for column, value in zip(rows, (entry[0], start, length, zlib.crc32(ids.tobytes()), len(entry[1]), first + number, offset, ids), strict=False):
                    column.append(value)
                entry[2] -= length
                if not entry[2]:
                    del held[k]
            kinds = [kind, *[pa.int64()] * 6, *[pa.list_(pa.int64())] * with_ids]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds, strict=True)], names=names)

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for row, ids in enumerate(tokenizer.encoded(batch.column(1))):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                held[key] = [batch.column(0)[row].as_py(), ids, len(ids)]
                mask = None
                if loss_column:
                    mask = masked(batch.column(2)[row].as_py(), len(ids))
                elif marker:
                    mask = after_prompt(batch.column(1)[row].as_py(), ids, tokenizer.sizes)
                bins.add(key, len(ids), mask)
                key += 1
                if len(bins.out) >= 4096:
                    yield told(kind)
        if kind is not None:
            bins.finish()
            yield told(kind)
        # a kept worker keeps the vocabulary only
        tokenizer.forget()
        released()

    more = ", ids array<bigint>" if with_ids else ""
    return df.select(id_column, text_column, *[loss_column] * (loss_column is not None)).mapInArrow(packed, f"`{id_column}` {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint{more}")
