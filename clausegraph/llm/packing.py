"""Cost-balanced packing into fixed-length training sequences (operator 10).

Attention costs a sequence ``linear * tokens + quadratic * sum(piece ** 2)``. Each window of documents is packed by
itself: whole multiples of the length are cut off as full sequences, then the remainders, longest first, go to the
sequence of lowest cost so far that still has room; a piece that fits nowhere is cut to fill the emptiest ones. A window
gets no more sequences than its tokens need, so all are full but one; that one's tokens open the next window. What is
left at a partition's end is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegraph.llm.bpe import encoder
from clausegraph.llm.common import gathered, small_batches

LENGTH, WINDOW_TOKENS = 4096, 4 << 20
#: Of a 1-billion-parameter model of width 2048: per token 12 * width, per pair of tokens 1.
LINEAR, QUADRATIC = 24576.0, 1.0


def pack(sizes: list[int], length: int = LENGTH, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start, tokens) pieces; every sequence is full but one at most, which is the last."""
    done, rest = [], []
    for item, n in enumerate(sizes):
        whole = n // length * length
        done += [[(item, at, length)] for at in range(0, whole, length)]
        if n > whole:
            rest.append((n - whole, item, whole))
    total = sum(r[0] for r in rest)
    count = -(-total // length)
    if not count:
        return done
    bins: list[list[tuple[int, int, int]]] = [[] for _ in range(count)]
    room = [length] * count
    room[-1] = total - (count - 1) * length  # the one that ends below the length
    cost = [0.0] * count
    order: list[tuple[float, int]] = []  # by cost: sequences with room for the piece at hand
    parked = [(-room[b], b) for b in range(count)]  # by room: the others, until pieces are short enough
    heapq.heapify(parked)
    pending = sorted(rest, key=lambda r: (-r[0], r[1]))

    def put(b: int, item: int, at: int, n: int) -> None:
        bins[b].append((item, at, n))
        room[b] -= n
        cost[b] += linear * n + quadratic * n * n

    for n, item, at in pending:
        while parked and -parked[0][0] >= n:
            _, b = heapq.heappop(parked)
            heapq.heappush(order, (cost[b], b))
        while n:  # with no room anywhere the piece is cut to fill those with most room
            _, b = heapq.heappop(order or parked)
            take = min(n, room[b])
            put(b, item, at, take)
            at, n = at + take, n - take
            if room[b]:
                heapq.heappush(parked, (-room[b], b))
    return done + bins


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = LENGTH, window_tokens: int = WINDOW_TOKENS, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_to and, if asked, ids.

    Tokens of a document: its text's ids (null text: none) and ``end_id``; null ids and repeated rows are packed as they
    are; further columns are ignored; an empty table gives no rows. No shuffle: each input partition is packed in windows
    of ``window_tokens``, which bounds memory; a document longer than a window makes a window of its own. A sequence id
    is partition * 2**40 + number, so the same files and splits give the same sequences, also when a task is run again.
    ``padded_to`` is what the sequence takes in storage: ``length``, or its own size where that is a power of two.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_to int" + ", ids array<int>" * with_ids
    names = [c.split()[0] for c in schema.split(", ")]

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, base, number = encoder(tokenizer), (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40, 0
        window: list[tuple[int | None, int, int, np.ndarray]] = []  # doc_id, start, tokens of the document, ids
        held = 0

        def emit(chosen: list[list[tuple[int, int, int]]], items: list) -> pa.RecordBatch:
            nonlocal number
            rows = []
            for pieces in chosen:
                used, at = sum(p[2] for p in pieces), 0
                stored = used if used & (used - 1) == 0 else length
                for item, start, n in pieces:
                    doc_id, before, total, ids = items[item]
                    own = ids[start : start + n].astype("<u4")
                    rows.append((doc_id, before + start, n, zlib.crc32(own), total, base + number, at, stored, own))
                    at += n
                number += 1
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            if with_ids:
                values = np.concatenate([r[8] for r in rows]).astype(np.int32) if rows else np.zeros(0, np.int32)
                columns.append(pa.ListArray.from_arrays(np.r_[0, np.cumsum([len(r[8]) for r in rows])].astype(np.int32), pa.array(values)))
            return pa.RecordBatch.from_arrays(columns, names)

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal window, held
            made = pack([len(w[3]) for w in window], length)
            open_one = made.pop() if made and sum(p[2] for p in made[-1]) < length else []
            for k in range(0, len(made), 128):
                yield emit(made[k : k + 128], window)
            window = [(window[i][0], window[i][1] + at, window[i][2], window[i][3][at : at + n]) for i, at, n in open_one]
            held = sum(len(w[3]) for w in window)
            if last and window:
                yield emit(_powers(held, window), window)

        for part in gathered(batches, "text", 8 << 20):
            ids, offsets = enc.encode(part.column(1))
            for k, doc_id in enumerate(part.column(0).to_pylist()):
                own = np.append(ids[offsets[k] : offsets[k + 1]], np.asarray(end_id, ids.dtype))
                window.append((doc_id, 0, len(own), own))
                held += len(own)
                if held >= window_tokens:
                    yield from flush(False)
        if window:
            yield from flush(True)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(sequences, schema)


def _powers(total: int, items: list) -> list[list[tuple[int, int, int]]]:
    """The items' tokens in sequences of falling powers of two."""
    out, item, at = [], 0, 0
    for bit in range(total.bit_length() - 1, -1, -1):
        if not total >> bit & 1:
            continue
        need, pieces = 1 << bit, []
        while need:
            n = min(need, len(items[item][3]) - at)
            if n:
                pieces.append((item, at, n))
            need, at = need - n, at + n
            if at == len(items[item][3]):
                item, at = item + 1, 0
        out.append(pieces)
    return out
