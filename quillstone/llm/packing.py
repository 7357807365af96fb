"""Order-preserving packing of documents into windows of at most ``size`` ids.

The documents of a partition, in its order, form one stream of ids. Cuts may lie at ends of
documents and sentences. Dynamic programming takes the cuts of least cost: a window costs its
padding up to ``size``, or none if its length is a power of two, and a cut within a document
costs ``cut_cost``; each window also costs ``window_cost``, so that short ones are the exception.
The least over all previous cuts within ``size`` comes from a monotone queue, the power-of-two
lengths from lookups. Every sentence end is a cut place; a sentence longer than ``size`` ids, and
none else, has inner ones, so that a way always exists. Streams are worked off in blocks: of a
block only the cuts are decided that every way further on shares, so the result is the optimum of
the whole stream, and what stays open is short.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quillstone.llm.bpe import ChunkIds, NumpyBpe, steps

SIZE = 2048
CUT_COST = 4.0
INNER_COST = 32.0
WINDOW_COST = 16.0
BLOCK_CHARS = 1 << 20
#: Windows that a stream holds at least before any is decided.
OPEN = 8


def best_backs(places: np.ndarray, costs: np.ndarray, size: int = SIZE, window_cost: float = WINDOW_COST) -> list[int]:
    """For 0 and each place the number of the cut before it on its cheapest way; ``places`` rise from over 0.

    The stream starts at 0. Neighbouring places must be at most ``size`` apart.
    """
    where = np.concatenate([[0], places])
    n = len(where)
    fits: dict[int, list[int]] = {}  # cuts before a cut by a power of two
    for w in (1 << k for k in range(size.bit_length())):
        k = np.searchsorted(where, where - w)
        for j in np.flatnonzero(where[k] == where - w).tolist():
            fits.setdefault(j, []).append(int(k[j]))
    first = np.searchsorted(where, where - size).tolist()  # the first cut within reach
    steps = zip(range(1, n), first[1:], where[1:].tolist(), (costs + window_cost).tolist())
    best, back = [0.0], [0]
    keys, cuts_at, head = [0.0], [0], 0  # a queue of best + place, rising
    for j, low, p, cost in steps:
        while cuts_at[head] < low:
            head += 1
        value, i = keys[head] - p + size, cuts_at[head]
        if j in fits:
            for k in fits[j]:
                if best[k] < value:
                    value, i = best[k], k
        value += cost
        best.append(value)
        back.append(i)
        value += p
        while len(keys) > head and keys[-1] >= value:
            keys.pop()
            cuts_at.pop()
        keys.append(value)
        cuts_at.append(j)
    return back


def best_cuts(places: np.ndarray, costs: np.ndarray, size: int = SIZE, window_cost: float = WINDOW_COST) -> list[int]:
    """Indices of the cuts on the cheapest way to the last place, which is one of them."""
    return _way(best_backs(places, costs, size, window_cost), len(places))


def _way(back: list[int], j: int) -> list[int]:
    cuts = []
    while j:
        cuts.append(j - 1)
        j = back[j]
    return cuts[::-1]


def settled_cuts(places: np.ndarray, costs: np.ndarray, size: int = SIZE, window_cost: float = WINDOW_COST) -> list[int]:
    """Indices of the cuts that stay whatever follows: those on the cheapest ways to all places within the last ``size``.

    A way further on passes through one of these places, and they soon share their beginning.
    """
    back = best_backs(places, costs, size, window_cost)
    ends = [-j for j in range(len(places), 0, -1) if places[j - 1] > places[-1] - size]
    heapq.heapify(ends)
    while True:
        j = -heapq.heappop(ends)
        while ends and -ends[0] == j:
            heapq.heappop(ends)
        if not ends:
            return _way(back, j)
        heapq.heappush(ends, -back[j])


def _places(sizes: np.ndarray, ends: np.ndarray, doc_ends: np.ndarray, size: int, costs: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Cut places after chunks and their costs; ``ends`` marks chunks that end a sentence."""
    place = np.cumsum(sizes)[ends]
    cost = np.full(len(place), costs[0])
    place, cost = np.concatenate([place, doc_ends]), np.concatenate([cost, np.zeros(len(doc_ends))])
    order = np.lexsort((cost, place))
    place, cost = place[order], cost[order]
    keep = (np.diff(place, prepend=-1) > 0) & (place > 0)
    place, cost = place[keep], cost[keep]
    gap, step = np.diff(place, prepend=0), max(1, size // 64)
    long = np.flatnonzero(gap > size)
    if len(long):
        inner = np.concatenate([np.arange(place[i] - gap[i] + step, place[i], step) for i in long])
        place, cost = np.concatenate([place, inner]), np.concatenate([cost, np.full(len(inner), costs[1])])
        order = np.argsort(place, kind="stable")
        place, cost = place[order], cost[order]
    return place, cost


class Packer:
    """Takes documents in order and gives pieces; ``flush`` closes the stream."""

    def __init__(self, first_sequence: int, size: int = SIZE, costs: tuple[float, float, float] = (CUT_COST, INNER_COST, WINDOW_COST)):
        self.sequence, self.size, self.costs = first_sequence, size, costs
        self.ids = np.empty(0, np.int32)
        self.chunks, self.ends = np.empty(0, np.int64), np.empty(0, bool)  # ids of the open chunks, sentence ends
        self.docs = np.empty((0, 3), np.int64)  # row, start of the open part, ids of the open part
        self.totals: dict[int, tuple] = {}

    def add(self, keys: list, ids: np.ndarray, each: np.ndarray, chunks: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> Iterator[tuple]:
        self.totals |= {int(r): (k, int(n)) for r, k, n in zip(rows, keys, each)}
        self.ids = np.concatenate([self.ids, ids])
        self.chunks, self.ends = np.concatenate([self.chunks, chunks]), np.concatenate([self.ends, ends])
        self.docs = np.concatenate([self.docs, np.stack([rows, np.zeros_like(rows), each], axis=1)])
        if len(self.ids) > OPEN * self.size:
            yield from self._windows(settled_cuts)

    def flush(self) -> Iterator[tuple]:
        if len(self.ids):
            yield from self._windows(best_cuts)

    def _windows(self, choose: Callable[..., list[int]]) -> Iterator[tuple]:
        place, cost = _places(self.chunks, self.ends, np.cumsum(self.docs[:, 2]), self.size, self.costs[:2])
        cuts = place[choose(place, cost, self.size, self.costs[2])]
        if not len(cuts):
            return
        starts = np.concatenate([[0], cuts[:-1]])
        stop = int(cuts[-1])
        doc_stop = np.cumsum(self.docs[:, 2])
        bounds = np.unique(np.concatenate([starts, [stop], doc_stop[doc_stop < stop]]))
        window = np.searchsorted(starts, bounds[:-1], side="right") - 1
        owner = np.searchsorted(doc_stop, bounds[:-1], side="right")
        for a, b, w, d in zip(bounds[:-1].tolist(), bounds[1:].tolist(), window.tolist(), owner.tolist()):
            row, begun, length = self.docs[d]
            key, total = self.totals[int(row)]
            yield key, int(begun + a - (doc_stop[d] - length)), b - a, self.ids[a:b], total, self.sequence + w, a - int(starts[w])
        self.sequence += len(cuts)
        self.ids = self.ids[stop:]
        first = int(np.searchsorted(doc_stop, stop, side="right"))
        for d in range(first):
            self.totals.pop(int(self.docs[d, 0]), None)
        gone = stop - (int(doc_stop[first - 1]) if first else 0)
        self.docs = self.docs[first:].copy()
        if len(self.docs):
            self.docs[0, 1] += gone
            self.docs[0, 2] -= gone
        chunk_stop = np.cumsum(self.chunks)
        k = int(np.searchsorted(chunk_stop, stop, side="right"))
        rest = self.chunks[k:].copy()
        if len(rest):
            rest[0] -= stop - (int(chunk_stop[k - 1]) if k else 0)
        self.chunks, self.ends = rest, self.ends[k:]


_encoders: dict[str, ChunkIds] = {}


#: Sentence ends, alone or before closing marks.
SENTENCE_END = "[.!?…。！？][\"')\\]}»”’]*$"


def ends_sentence(chunks: pa.Array) -> pa.Array:
    return pc.match_substring_regex(chunks, SENTENCE_END)


def _encoder(path: str) -> ChunkIds:
    if path not in _encoders:
        _encoders[path] = ChunkIds(NumpyBpe(path), ends_sentence)
    return _encoders[path]


SCHEMA = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """Pieces of ``docs``: id_col, start, length, ids, doc_tokens, sequence_id, offset.

    A document is its text's ids, equal to the tokenizers library's, and then ``end_id``; a null or empty
    text is ``end_id`` alone. ``ids`` holds the piece's ids as little-endian 32-bit numbers. Each
    partition is packed by itself, without a shuffle; its sequences are numbered from partition
    number times 2**40. Repeated rows are packed each; an empty table has no pieces. Other
    columns of ``docs`` are not read.
    """
    key_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {key_type}, {SCHEMA}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _encoder(path)
        packer = Packer(TaskContext.get().partitionId() << 40, size)
        fields = None
        row = 0
        pending: list[tuple] = []

        def out(pieces: list[tuple]) -> pa.RecordBatch:
            key, start, length, ids, total, sequence, offset = zip(*pieces)
            columns = [pa.array(key, fields), *(pa.array(x, pa.int64()) for x in (start, length))]
            columns += [pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())]
            columns += [pa.array(x, pa.int64()) for x in (total, sequence, offset)]
            return pa.RecordBatch.from_arrays(columns, [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            fields = batch.column(0).type
            keys = batch.column(0).to_pylist()
            at = 0
            for step in steps(batch.column(1), BLOCK_CHARS):
                ids, each, counts, sizes, ends = cache.texts(step)
                # the end id is a chunk of its own after each document
                put, where = np.cumsum(each), np.cumsum(counts)
                ids = np.insert(ids, put, end_id)
                sizes, ends = np.insert(sizes, where, 1), np.insert(ends, where, False)
                rows = np.arange(row, row + len(step))
                pending += packer.add(keys[at : at + len(step)], ids, each + 1, sizes, ends, rows)
                at += len(step)
                row += len(step)
                if pending:
                    yield out(pending)
                    pending = []
        pending += packer.flush()
        if pending:
            yield out(pending)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
