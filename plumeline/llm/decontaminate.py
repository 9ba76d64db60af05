"""Benchmark decontamination by latent semantic retrieval, confirmed word by word.

Documents and benchmark items are cut into passages of WINDOW words, half overlapping. A passage is a
TF-IDF vector over hashed words; a randomised singular value decomposition gives a latent space in which
passages are searched by cosine. The decomposition is distributed: tasks multiply their rows of A by a
random matrix and back by A's transpose, and only the small products are added up, in blocks of rows where
they are, so that the driver receives one product whatever the input. Inverse document frequencies, the basis
and the search take every passage of every document.

A candidate, a passage whose cosine with an item's is COSINE at least, must hold nearby NEAR_SHARE of the
item passage's telling words (those of a high inverse frequency); paraphrases that replace most of these are
lost. Places less than a quarter passage after one already tried are not tried again. A candidate is then aligned with its benchmark item: the longest common subsequence of words around it,
as a share of the item, and the same for the item's last part (its answer). A share of STRONG is a hit by
itself; a share of WEAK (a paraphrase) is one if the answer is there too.

The benchmark is a stated query set: it is taken in blocks of BLOCK_ITEMS items, a pass over the documents
for each, so that what tasks receive is bounded.

Defined results: null and empty texts match nothing, on either side; items are matched in lower case
(A-Z) by their white-space-separated words without edge punctuation; repeated rows are each reported;
items that repeat are each reported; empty tables give an empty result; further columns are ignored by
`find_contamination` and carried through unchanged by `drop_contaminated`.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, in_batches, mix64, span_hashes, text_or_empty, to_buffer

WINDOW = 32
HALF = WINDOW // 2
BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
#: Dimensions of the latent space; the leading ones, which tell languages apart, are left out.
DIMENSIONS, LEADING = 64, 6
#: Blocks of rows in which the tasks' products are added up.
SUM_BLOCKS = 16
BLOCK_ITEMS = 10_000
COSINE = 0.3
#: A word is telling if its inverse frequency is at least this; of a candidate's telling words, this share must stand near the passage.
TELLING, NEAR_SHARE = 3.0, 0.5
_LANES = 4
STRONG, WEAK, ANSWER = 0.8, 0.55, 0.7

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Letters and digits, and all bytes beyond ASCII, make up words.
_SOLID = np.zeros(256, bool)
_SOLID[48:58] = _SOLID[65:91] = _SOLID[97:123] = _SOLID[128:] = True


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the first word of each row (one more ends the last)."""
    solid = _SOLID[raw]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return span_hashes(_FOLD[raw], starts, ends), np.searchsorted(starts, offsets)


def _halves(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each half passage begins among the words, and its row; a row's last one may be short."""
    counts = -(-np.diff(first) // HALF)
    row = np.repeat(np.arange(len(counts)), counts)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    return first[:-1][row] + nth * HALF, row


def _buckets(hashed: np.ndarray) -> np.ndarray:
    return (hashed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _rows(bucket: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The buckets of each half passage in a row; BUCKETS stands for none."""
    sizes = np.diff(np.append(begins, len(bucket)))
    rows = np.full((len(begins), HALF), BUCKETS, np.uint16)
    rows[np.repeat(np.arange(len(begins)), sizes), np.arange(len(bucket)) - np.repeat(begins, sizes)] = bucket
    return rows


def _distinct(bucket: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Each half passage's buckets, once each; BUCKETS stands for none."""
    rows = _rows(bucket, begins)
    rows.sort(axis=1)
    again = rows[:, 1:] == rows[:, :-1]
    rows[:, 1:][again] = BUCKETS
    return rows.ravel()


def _marks(hashed: np.ndarray, telling: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Bits of the telling words of each half passage, _LANES longs a row."""
    one = np.where(telling, np.uint64(1) << (hashed & np.uint64(63)), np.uint64(0))
    lane = (hashed >> np.uint64(6)) & np.uint64(_LANES - 1)
    return np.stack([np.bitwise_or.reduceat(np.where(lane == k, one, np.uint64(0)), begins) for k in range(_LANES)], axis=1)


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many half passages hold each bucket; the last number is of all half passages."""
    total = np.zeros(BUCKETS + 1, np.int64)
    for batch in batches:
        raw, offsets = to_buffer(batch.column(0))
        for a, b in chunks(offsets):
            hashed, first = word_hashes(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            begins, _ = _halves(first)
            if not len(begins):
                continue
            total[:BUCKETS] += np.bincount(_distinct(_buckets(hashed), begins), minlength=BUCKETS + 1)[:BUCKETS]
            total[BUCKETS] += len(begins)
    if total[BUCKETS]:
        yield pa.RecordBatch.from_arrays([pa.array([total])], schema=pa.schema([("counts", pa.list_(pa.int64()))]))


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """Over all half passages of all documents; BUCKETS numbers reach the driver."""
    parts = in_batches(docs.select(text_or_empty().alias("text")), _counter, "counts array<bigint>")
    rows = parts.select(F.posexplode("counts").alias("bucket", "n")).groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(BUCKETS + 1)
    for r in rows:
        counts[r.bucket] = r.n
    return np.log((counts[BUCKETS] + 1) / (counts[:BUCKETS] + 1)).astype(np.float32)


def _add_by_bucket(product: np.ndarray, rows: np.ndarray, bucket: np.ndarray, owner: np.ndarray) -> None:
    """Add to product, at each word's bucket, the row of its half passage."""
    order = np.argsort(bucket.astype(np.uint16), kind="stable")
    sorted_, own = bucket[order], owner[order]
    begins = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    sizes = np.diff(np.append(begins, len(sorted_)))
    for k in np.flatnonzero(sizes > 24):
        product[sorted_[begins[k]]] += rows.take(own[begins[k] : begins[k] + sizes[k]], axis=0).sum(axis=0)
    # the others' first words, then their second ones, and so on: each bucket once a pass
    left, nth = np.flatnonzero(sizes <= 24), 0
    while len(left):
        product[sorted_[begins[left]]] += rows.take(own[begins[left] + nth], axis=0)
        nth += 1
        left = left[sizes[left] > nth]


_PRODUCT = pa.schema([("block", pa.int32()), ("product", pa.binary())])


def _multiplier(idf: np.ndarray, seed: int, width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random = np.random.default_rng(seed).normal(size=(BUCKETS, width)).astype(np.float32) * idf[:, None]
        # a row of zeros stands for the words that a short half passage lacks
        random = np.concatenate([random, np.zeros((1, width), np.float32)])
        product, used = np.zeros((BUCKETS, width), np.float32), False
        for batch in batches:
            raw, offsets = to_buffer(batch.column(0))
            for a, b in chunks(offsets, 500_000):
                hashed, first = word_hashes(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                begins, _ = _halves(first)
                if not len(begins):
                    continue
                bucket = _buckets(hashed)
                places = _rows(bucket, begins).astype(np.int64)
                rows = np.empty((len(begins), width), np.float32)
                for k in range(0, len(places), 1024):
                    part = random.take(places[k : k + 1024, 0], axis=0)
                    for j in range(1, HALF):
                        part += random.take(places[k : k + 1024, j], axis=0)
                    rows[k : k + 1024] = part
                _add_by_bucket(product, rows, bucket, np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(hashed)))))
                used = True
        for k, part in enumerate(np.split(product * idf[:, None], SUM_BLOCKS) if used else []):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()])], schema=_PRODUCT)

    return run


def _adder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums, in doubles, of the products of each block."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found = np.frombuffer(part.as_buffer(), np.float32)
            sums[k] = sums[k] + found if k in sums else found.astype(np.float64)
    for k, part in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()])], schema=_PRODUCT)


def latent_basis(docs: DataFrame, idf: np.ndarray, seed: int = 5) -> np.ndarray:
    """An orthonormal basis (BUCKETS x DIMENSIONS) of the passages' leading row space, of all documents, by a randomised range finder."""
    width = DIMENSIONS + LEADING + 10
    parts = in_batches(docs.select(text_or_empty().alias("text")), _multiplier(idf, seed, width), "block int, product binary")
    product = np.zeros((SUM_BLOCKS, BUCKETS // SUM_BLOCKS, width))
    for r in in_batches(parts.repartition(SUM_BLOCKS, "block"), _adder, "block int, product binary").collect():
        product[r["block"]] += np.frombuffer(bytes(r["product"])).reshape(product.shape[1:])
    product = product.reshape(BUCKETS, width)
    left, _, _ = np.linalg.svd(product, full_matrices=False)
    return left[:, LEADING : LEADING + DIMENSIONS].astype(np.float32)


@dataclass
class Queries:
    items: list[tuple[int, np.ndarray]]  # item_id and word hashes
    vectors: np.ndarray  # of the items' passages
    item: np.ndarray  # which item each passage is of
    at: np.ndarray  # where in the item it begins
    marks: np.ndarray  # bits of its telling words


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def build_queries(items: list[tuple[int, str]], idf: np.ndarray, basis: np.ndarray) -> Queries:
    kept, vectors, of, at, marks = [], [], [], [], []
    space = basis * idf[:, None]
    for item_id, text in items:
        raw = np.frombuffer(text.encode(), np.uint8)
        hashed, _ = word_hashes(raw, np.array([0, len(raw)]))
        if not len(hashed):
            continue
        starts = sorted({*range(0, max(1, len(hashed) - WINDOW + 1), HALF), max(0, len(hashed) - WINDOW)})
        for s in starts:
            vectors.append(space[_buckets(hashed[s : s + WINDOW])].sum(axis=0))
            of.append(len(kept))
            at.append(s)
            own = hashed[s : s + WINDOW]
            marks.append(_marks(own, idf[_buckets(own)] >= TELLING, np.array([0]))[0])
        kept.append((item_id, hashed))
    return Queries(kept, _unit(np.array(vectors, np.float32).reshape(-1, DIMENSIONS)), np.array(of, int), np.array(at, int), np.array(marks, np.uint64).reshape(-1, _LANES))


def common_subsequence(item: list[int], other: list[int]) -> int:
    """Length of the longest common subsequence, a whole row of the table at a time in the bits of one number."""
    places: dict[int, int] = defaultdict(int)
    for i, x in enumerate(item):
        places[x] |= 1 << i
    full = (1 << len(item)) - 1
    row = full
    for x in other:
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(item) - row.bit_count()


class Searcher:
    def __init__(self, idf: np.ndarray, basis: np.ndarray, queries: Queries):
        # a row of zeros stands for the words that a short half passage lacks
        self.space = np.concatenate([basis * idf[:, None], np.zeros((1, basis.shape[1]), np.float32)])
        self.queries, self.telling = queries, idf >= TELLING
        self.lists = [x.tolist() for _, x in queries.items]
        self.needed = NEAR_SHARE * np.bitwise_count(queries.marks).sum(axis=1)

    def hits(self, raw: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, float, float, float]]:
        """(row, item, cosine, share of the item, share of its answer) of each confirmed pair."""
        hashed, first = word_hashes(raw, offsets)
        begins, row = _halves(first)
        if not len(begins) or not len(self.queries.vectors):
            return []
        bucket = _buckets(hashed)
        rows = _rows(bucket, begins).astype(np.int64)
        part = np.concatenate([self.space[rows[k : k + 2048]].sum(axis=1) for k in range(0, len(rows), 2048)])
        passage = part.copy()
        same = np.flatnonzero(row[1:] == row[:-1])
        passage[same] += part[same + 1]
        passage = _unit(passage)
        # telling words of each passage and of the half passages around it
        own = _marks(hashed, self.telling[bucket], begins)
        around = own.copy()
        for back in (1, 2):
            near_by = np.flatnonzero(row[back:] == row[:-back])
            around[near_by] |= own[near_by + back]
        before = np.flatnonzero(row[1:] == row[:-1])
        around[before + 1] |= own[before]
        found: dict[tuple[int, int], list[tuple[float, int]]] = defaultdict(list)
        step = max(1, 4_000_000 // len(self.queries.vectors))
        for k in range(0, len(passage), step):
            near = passage[k : k + step] @ self.queries.vectors.T
            p, q = np.nonzero(near >= COSINE)
            shared = np.bitwise_count(around[k + p] & self.queries.marks[q]).sum(axis=1)
            good = shared >= self.needed[q]
            for p1, q1 in zip(p[good].tolist(), q[good].tolist(), strict=True):
                place = int(begins[k + p1]) - int(self.queries.at[q1])
                found[int(row[k + p1]), int(self.queries.item[q1])].append((float(near[p1, q1]), place))
        out = []
        for (r, i), places in found.items():
            item = self.lists[i]
            best = (0.0, 0.0, 0.0)
            tried = None
            for cosine, place in sorted(places, key=lambda x: x[1]):
                if tried is not None and place - tried < HALF // 2:
                    continue
                tried = place
                lo, hi = max(int(first[r]), place - WINDOW), min(int(first[r + 1]), place + len(item) + WINDOW)
                region = hashed[lo:hi].tolist()
                there = set(region)
                if sum(x in there for x in item) < WEAK * len(item):
                    continue
                share = common_subsequence(item, region) / len(item)
                if share >= WEAK and share > best[1]:
                    answer = item[-max(1, len(item) // 4) :]
                    best = (cosine, share, common_subsequence(answer, region) / len(answer))
            if best[1] >= STRONG or (best[1] >= WEAK and best[2] >= ANSWER):
                out.append((r, i, *best))
        return out


_HITS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs_share", pa.float64()), ("answer_share", pa.float64())])
_HIT_SCHEMA = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double"


def _finder(searcher: Searcher) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = to_buffer(batch.column(1))
            ids = batch.column(0)
            for a, b in chunks(offsets):
                hits = searcher.hits(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if hits:
                    columns = [[ids[a + h[0]].as_py() for h in hits], [searcher.queries.items[h[1]][0] for h in hits], *([h[k] for h in hits] for k in (2, 3, 4))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, _HITS, strict=True)], schema=_HITS)

    return run


def _filterer(searcher: Searcher, at: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = to_buffer(batch.column(at))
            keep = np.ones(len(batch), bool)
            for a, b in chunks(offsets):
                for h in searcher.hits(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
                    keep[a + h[0]] = False
            yield batch.filter(pa.array(keep))

    return run


def searchers(docs: DataFrame, benchmark: DataFrame) -> Iterator[Searcher]:
    """One for each block of the benchmark."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text"))
    blocks = -(-items.count() // BLOCK_ITEMS)
    if not blocks:
        return
    idf = inverse_frequencies(docs)
    basis = latent_basis(docs, idf)
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        yield Searcher(idf, basis, build_queries([(r.item_id, r.text) for r in own], idf, basis))


def find_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and benchmark item that it holds: doc_id, item_id, cosine, lcs_share and answer_share."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    out = None
    for searcher in searchers(docs, benchmark):
        found = in_batches(rows, _finder(searcher), _HIT_SCHEMA)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], _HIT_SCHEMA) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all their columns, that hold no benchmark item."""
    out = docs
    for searcher in searchers(docs, benchmark):
        out = in_batches(out, _filterer(searcher, docs.columns.index("text")), docs.schema)
    return out
