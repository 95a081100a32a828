"""Hierarchical multi-length packing."""

from __future__ import annotations

import heapq
import struct
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from presswerk.llm.common import in_groups
from presswerk.llm.tokens import word_tokenizer

#: Context sizes, longest first; all powers of two.
TIERS = (4096, 2048, 1024, 512, 256)
END_ID = 2

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Packer:
    """Packs token buffers into sequences, one pool of documents at a time.

    A document's whole windows of the longest tier are sequences of their own;
    its remainder is routed to the smallest tier that holds it.  A pool is then
    packed from the longest remainder down: it opens a window of its tier, the
    gap is filled with the longest remainders of shorter tiers that fit, and
    what is still open with the head of the shortest remainder that covers it,
    whose tail is routed anew.  Pieces that cannot fill a window stay for the
    next pool; the last ones of all are cut at the binary digits of their total,
    so that every sequence is full and its length a power of two.

    Sequences of a pool are dealt to step groups, the longest first and always
    to the lightest group, so that groups hold near-equal numbers of tokens.
    """

    def __init__(self, tiers=TIERS, pool_tokens: int = 1 << 21, step_tokens: int = 64 * TIERS[0]):
        self.tiers, self.pool_tokens, self.step_tokens = tiers, pool_tokens, step_tokens
        self.docs: dict[int, tuple] = {}  # number -> (id, buffer)
        self.by_length: dict[int, list] = {}
        self.lengths: list[int] = []
        self.pooled = self.sequences = self.steps = self.added = 0
        self.done: list[list] = []

    def _put(self, doc: int, start: int, length: int) -> None:
        if length not in self.by_length:
            self.by_length[length] = []
            insort(self.lengths, length)
        self.by_length[length].append((doc, start, length))

    def _take(self, length: int) -> tuple:
        pieces = self.by_length[length]
        piece = pieces.pop()
        if not pieces:
            del self.by_length[length]
            self.lengths.pop(bisect_left(self.lengths, length))
        return piece

    def add(self, doc_id, ids: bytes) -> None:
        n, longest = len(ids) // 4, self.tiers[0]
        doc = self.added = self.added + 1
        self.docs[doc] = (doc_id, ids)
        whole = n - n % longest
        self.done += [[(doc, at, longest)] for at in range(0, whole, longest)]
        if n > whole:
            self._put(doc, whole, n - whole)
        self.pooled += n

    def _window(self, size: int) -> list | None:
        """Pieces that fill a window of ``size``, the longest first; None (and nothing taken) if too few are left."""
        pieces, gap = [], size
        while gap and self.lengths:
            at = bisect_right(self.lengths, gap)
            if at:
                piece = self._take(self.lengths[at - 1])
            else:
                doc, start, length = self._take(self.lengths[0])
                self._put(doc, start + gap, length - gap)
                piece = (doc, start, gap)
            pieces.append(piece)
            gap -= piece[2]
        if gap:
            for piece in pieces:
                self._put(*piece)
            return None
        return pieces

    def flush(self, last: bool = False) -> Iterator[tuple]:
        while self.lengths:
            tier = min(t for t in self.tiers if t >= self.lengths[-1])
            pieces = self._window(tier)
            if pieces is None:
                break
            self.done.append(pieces)
        if last:
            rest = sum(k * len(v) for k, v in self.by_length.items())
            while rest:
                size = 1 << rest.bit_length() - 1
                self.done.append(self._window(size))
                rest -= size
        yield from self._emit()
        keep = {p[0] for v in self.by_length.values() for p in v}
        self.docs = {k: v for k, v in self.docs.items() if k in keep}
        self.pooled = sum(k * len(v) for k, v in self.by_length.items())

    def _emit(self) -> Iterator[tuple]:
        sized = [(sum(p[2] for p in s), s) for s in self.done]
        groups = max(1, round(sum(n for n, _ in sized) / self.step_tokens))
        load = [(0, g) for g in range(groups)]
        for size, pieces in sorted(sized, key=lambda x: -x[0]):
            tokens, group = heapq.heappop(load)
            heapq.heappush(load, (tokens + size, group))
            offset = 0
            for doc, start, length in pieces:
                doc_id, ids = self.docs[doc]
                yield doc_id, start, length, ids[4 * start : 4 * (start + length)], len(ids) // 4, self.sequences, offset, size, self.steps + group
                offset += length
            self.sequences += 1
        self.steps += groups * bool(sized)
        self.done = []


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", tiers=TIERS, pool_tokens: int = 1 << 21, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with their ids, sequence, offset, tier (the sequence's length) and step group.

    Each input partition is packed by itself, in pools of about ``pool_tokens``,
    so that nothing is shuffled, memory is bounded by a pool and the longest
    document, and a lost task is run again with the same result; sequence and
    step numbers hold the partition's number in their upper bits.

    Null and empty texts give the end id only.  Rows that repeat a document are
    packed each; a null id stays null.  An empty table gives no rows.  Other
    columns are not read.
    """

    def run(batches):
        tok, end = word_tokenizer(tokenizer), struct.pack("<I", end_id)
        packer, base = Packer(tiers, pool_tokens), TaskContext.get().partitionId() << 36
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

        def out(rows):
            part = []
            for r in rows:
                part.append((*r[:5], base + r[5], r[6], r[7], base + r[8]))
                if len(part) == 2000:
                    yield table(part)
                    part = []
            if part:
                yield table(part)

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            keys = iter(batch.column(0).to_pylist())
            for texts in in_groups(batch.column(1)):
                for ids in tok.ids(texts):
                    packer.add(next(keys), ids + end)
                    if packer.pooled >= pool_tokens:
                        yield from out(packer.flush())
        yield from out(packer.flush(last=True))

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, SCHEMA)
