"""Packing token sequences by best-fit decreasing.

A document is its token ids and one end id. Documents longer than a sequence are first cut into full
windows, which need no search. What remains is sorted by length and placed, longest first, in the open
sequence with the least room that still holds it; a segment tree indexed by remaining capacity finds
that room in logarithmic time, and a stack for each capacity holds the sequences with that room.

Each task packs its own input in blocks of at most BLOCK remainders, in one pass and without a shuffle,
so memory is bounded and a lost task is simply run again. A block leaves at most a few part-filled
sequences beyond what best-fit over everything would leave.

Defined results: null and empty texts are the single end id; repeated rows are packed once each; a null
doc_id stays null; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, in_batches, to_buffer
from .tokenization import encoder

WINDOW = 1024
#: Remainders that are packed together.
BLOCK = 250_000


class RoomTree:
    """Counts of open sequences by remaining capacity; finds the tightest capacity that is at least n."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, n: int = 1) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += n
            at >>= 1

    def tightest(self, need: int) -> int | None:
        at = need + self.leaves
        if self.count[at]:
            return need
        # climb to the first right-hand neighbour that has an open sequence, then go down its left edge
        while at > 1 and (at & 1 or not self.count[at + 1]):
            at >>= 1
        if at <= 1:
            return None
        at += 1
        while at < self.leaves:
            at *= 2
            at += not self.count[at]
        return at - self.leaves


def best_fit(lengths: np.ndarray, capacity: int, first: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and offset of each length, longest first; and the number after the last sequence opened."""
    tree, stacks = RoomTree(capacity), [[] for _ in range(capacity + 1)]
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    following = first
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        room = tree.tightest(need)
        if room is None:
            sequence, room, following = following, capacity, following + 1
        else:
            sequence = stacks[room].pop()
            tree.add(room, -1)
        where[i], offset[i] = sequence, capacity - room
        if room > need:
            stacks[room - need].append(sequence)
            tree.add(room - need)
    return where, offset, following


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])


def _packer(path: str, end_id: int, window: int, block: int, with_ids: bool, special_ids: bool) -> Callable:
    schema = _ARROW.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else _ARROW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # each task numbers its sequences in a range of its own
        following = TaskContext.get().partitionId() << 36
        held: list[tuple] = []
        for batch in batches:
            # some texts at a time: the ids of a whole batch would take several times its size
            for a, b in chunks(to_buffer(batch.column(1))[1]):
                some = batch.slice(a, b - a)
                ids, counts = encoder(path, special_ids).encode([t or "" for t in some.column(1).to_pylist()])
                ends = np.cumsum(counts)
                full: list[tuple] = []
                for i, doc_id in enumerate(some.column(0).to_pylist()):
                    own = np.append(ids[ends[i] - counts[i] : ends[i]], np.uint32(end_id)).astype("<u4")
                    n = len(own)
                    for start in range(0, n, window):
                        piece = own[start : start + window]
                        row = (doc_id, start, len(piece), zlib.crc32(piece.tobytes()), n, piece if with_ids else None)
                        if len(piece) == window:
                            full.append((row, following, 0))
                            following += 1
                        else:
                            held.append(row)
                if full:
                    yield _rows(full, schema)
            if len(held) >= block:
                placed, following = _place(held, window, following)
                yield from (_rows(placed[k : k + 20_000], schema) for k in range(0, len(placed), 20_000))
                held = []
        if held:
            placed, _ = _place(held, window, following)
            yield from (_rows(placed[k : k + 20_000], schema) for k in range(0, len(placed), 20_000))

    return run


def _place(held: list[tuple], window: int, first: int) -> tuple[list, int]:
    where, offset, following = best_fit(np.array([r[2] for r in held], np.int64), window, first)
    return list(zip(held, where.tolist(), offset.tolist(), strict=True)), following


def _rows(placed: list, schema: pa.Schema) -> pa.RecordBatch:
    columns = [[r[k] for r, _, _ in placed] for k in range(5)] + [[s for _, s, _ in placed], [o for _, _, o in placed]]
    arrays = [pa.array(c, type=pa.int64()) for c in columns]
    if len(schema) > len(arrays):
        arrays.append(pa.array([r[5].astype(np.int32) for r, _, _ in placed], type=schema.field("ids").type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def pack(docs: DataFrame, tokenizer_file: str, end_id: int = 0, window: int = WINDOW, block: int = BLOCK, with_ids: bool = False, special_ids: bool = False) -> DataFrame:
    """One row per piece of a document, with its place; with_ids adds the piece's ids themselves; special_ids as in Encoder."""
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return in_batches(kept, _packer(tokenizer_file, end_id, window, block, with_ids, special_ids), SCHEMA + ", ids array<int>" * with_ids)


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """The packed rows themselves from pack(with_ids=True): sequence_id, ids padded to the window, n_tokens."""
    whole = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"]))
    packed = pieces.groupBy("sequence_id").agg(whole.alias("ids"), F.sum("length").alias("n_tokens"))
    pad = F.array_repeat(F.lit(pad_id), (F.lit(window) - F.col("n_tokens")).cast("int"))
    return packed.select("sequence_id", F.concat("ids", pad).alias("ids"), "n_tokens")
