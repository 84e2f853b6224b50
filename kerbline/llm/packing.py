"""Cost-balanced packing of documents' token ids into sequences of bounded length.

A sequence costs LINEAR per token and QUADRATIC per squared length of each piece in it (attention stays inside a piece).
Each task packs the documents it reads, a window of them at a time: whole capacities are cut from longer documents,
then what is left goes, longest first, to the sequence of lowest cost with room for it (of equal costs, the first); where
no sequence has, the cheapest is filled up and the rest goes on. A window has exactly as many sequences as its ids fill;
the ids beyond the last full one go on into the next window, and at a task's end into sequences at powers of two. So no
sequence is padded and nothing is shuffled.

Defined cases: a null or empty text is its end id; a null id and repeated rows are packed like others; an empty table
gives an empty result; a document longer than a window is cut into full sequences; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binaries, in_pieces, texts, trimmed
from .tokens import kept_encoder

LENGTH = 2048
WINDOW = 1 << 20
#: Bytes of words kept: less than for token files, as packing comes last of several stages in the same workers.
KEPT = 64 << 20
LINEAR, QUADRATIC = 1.0, 1.0 / 2048


def assign(lengths: list[int], length: int = LENGTH, last: bool = True) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int]]]:
    """(document, start, length, sequence, offset) of the pieces, and (document, start) of what doesn't fill a sequence.

    With last, the rest is packed too, at powers of two, and the second list is empty.
    """
    total = sum(lengths)
    full, rest = divmod(total, length)
    left = []
    if not last:
        # the ids at the end of the last documents wait for the next window
        k, lengths = len(lengths), list(lengths)
        while rest:
            k -= 1
            taken = min(rest, lengths[k])
            lengths[k] -= taken
            rest -= taken
            left.append((k, lengths[k]))
        left.reverse()
    sizes = [length] * full + [1 << b for b in reversed(range(length.bit_length())) if rest >> b & 1]
    pieces, some, sequence = [], [], 0
    for doc, n in enumerate(lengths):
        cut = n - n % length
        for start in range(0, cut, length):
            pieces.append((doc, start, length, sequence, 0))
            sequence += 1
        if n > cut:
            some.append((n - cut, doc, cut))
    size_of = np.array(sizes[sequence:], np.int64)
    room = size_of.copy()
    cost = LINEAR * (length - size_of)  # a shorter sequence starts as if what it lacks were there
    for n, doc, start in sorted(some, key=lambda x: (-x[0], x[1])):
        while n:
            with_room = np.where(room >= n, cost, np.inf)
            k = int(with_room.argmin())
            if with_room[k] == np.inf:
                k = int(np.where(room > 0, cost, np.inf).argmin())
            size = min(n, int(room[k]))
            pieces.append((doc, start, size, sequence + k, int(size_of[k] - room[k])))
            room[k] -= size
            cost[k] += LINEAR * size + QUADRATIC * size * size
            n, start = n - size, start + size
    return pieces, left


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _pack(batches: Iterator[pa.RecordBatch], path: str, end: int, length: int, ids: bool) -> Iterator[pa.RecordBatch]:
    trimmed()
    encoder, sequence = kept_encoder(path, KEPT), TaskContext.get().partitionId() << 40
    waiting: list[tuple[int | None, int, np.ndarray, int]] = []  # document, ids before, ids, ids in all
    size = 0

    def packed(last: bool) -> pa.RecordBatch:
        nonlocal waiting, size, sequence
        pieces, left = assign([len(x[2]) for x in waiting], length, last)
        rows = [(waiting[d], start, n, s, offset) for d, start, n, s, offset in pieces]
        crc = [zlib.crc32(x[2][start : start + n].tobytes()) for x, start, n, _, _ in rows]
        columns = [[x[0] for x, *_ in rows], [x[1] + start for x, start, *_ in rows], [r[2] for r in rows], crc, [x[3] for x, *_ in rows], [sequence + r[3] for r in rows], [r[4] for r in rows]]
        arrays = [pa.array(c, pa.int64()) for c in columns]
        if ids:
            arrays.append(pa.array([x[2][start : start + n].astype(np.int64) for x, start, n, _, _ in rows], pa.list_(pa.int64())))
        sequence += max((r[3] for r in rows), default=-1) + 1
        waiting = [(waiting[d][0], waiting[d][1] + start, waiting[d][2][start:].copy(), waiting[d][3]) for d, start in left]
        size = sum(len(x[2]) for x in waiting)
        return pa.RecordBatch.from_arrays(arrays, names=_NAMES + ["ids"] * ids)

    for batch in in_pieces(batches, 1 << 20):
        flat, lengths = encoder(binaries(batch, 1), end)
        flat = flat.astype("<u4")
        for k, part in zip(batch.column(0).to_pylist(), np.split(flat, np.cumsum(lengths)[:-1]), strict=True):
            waiting.append((k, 0, part, len(part)))
        size += len(flat)
        if size >= WINDOW:
            yield packed(False)
            trimmed()
    if waiting:
        yield packed(True)


def pack(docs: DataFrame, path: str, end: int, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with ids its ids.

    length is a power of two.
    """
    rows = texts(docs, id_col, text_col)
    schema = ", ".join(f"{x} long" for x in _NAMES) + ", ids array<long>" * ids
    return rows.mapInArrow(partial(_pack, path=path, end=end, length=length, ids=ids), schema)
