"""Language identification by a byte convolutional network, trained in numpy.

A text is cut into consecutive windows of WINDOW bytes that cover all of it. In each window, bytes are
embedded, filters of several widths slide over them, each filter keeps its largest response, and a
softmax gives the languages' probabilities; a text's probabilities are the mean over its windows,
weighted by their bytes. A network of a few thousand numbers is all that tasks receive.

The MOST_LABELS languages with the most labelled texts are learnt (ties by name); texts of others get one of those.
Training takes windows, spread over whole texts, from a sample of about SAMPLE_A_LABEL labelled documents
for each language, chosen by a hash of the id; prediction uses the text alone.

Defined results: null texts and texts without a letter are `und` with score 0; without any labelled text
all are `und`; rows with a null label are not learnt from; repeated rows get equal results; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, give_back, in_batches, text_or_empty, to_buffer

UNKNOWN = "und"
WINDOW, EMBED, WIDTHS, FILTERS = 256, 8, (2, 3, 4), 12
#: Labelled documents of each language that training reads, about, and windows of each.
SAMPLE_A_LABEL, WINDOWS_A_TEXT = 300, 4
#: Languages that the network may learn.
MOST_LABELS = 1000
#: Bytes of windows in one matrix product.
PART = 1 << 18

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


@dataclass
class ByteCnn:
    labels: list[str]
    table: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # (widest * EMBED) x (widths * FILTERS); narrower filters are zero beyond their width
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def _columns(self, windows: np.ndarray) -> np.ndarray:
        """Rows of neighbouring bytes' embeddings: (windows * positions) x (widest * EMBED)."""
        wide = max(WIDTHS)
        seen = self.table[_FOLD[np.pad(windows, ((0, 0), (0, wide - 1)))]]
        return np.concatenate([seen[:, j : j + WINDOW] for j in range(wide)], axis=2)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = []
        for k in range(0, len(windows), PART // WINDOW):
            part = windows[k : k + PART // WINDOW]
            columns = self._columns(part).reshape(-1, self.filters.shape[0])
            pooled = (columns @ self.filters).reshape(len(part), WINDOW, -1).max(axis=1)
            out.append(_softmax(np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias))
        return np.concatenate(out) if out else np.zeros((0, len(self.labels)), np.float32)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, labels: list[str], epochs: int = 6, rate: float = 4e-3, seed: int = 7) -> ByteCnn:
    """Fit the network by Adam on windows (n x WINDOW bytes), each label weighing the same."""
    names = sorted(set(labels))
    target = np.array([names.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    wide, n_filters = max(WIDTHS), len(WIDTHS) * FILTERS
    within = np.zeros((wide * EMBED, n_filters), np.float32)
    for i, w in enumerate(WIDTHS):
        within[: w * EMBED, i * FILTERS : (i + 1) * FILTERS] = 1
    f32 = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    net = ByteCnn(names, f32(256, EMBED, scale=0.5), f32(wide * EMBED, n_filters, scale=0.3) * within, np.zeros(n_filters, np.float32), f32(n_filters, len(names), scale=0.2), np.zeros(len(names), np.float32))
    held = [net.table, net.filters, net.bias, net.out, net.out_bias]
    first, second, step = [np.zeros_like(p) for p in held], [np.zeros_like(p) for p in held], 0
    weight = (len(target) / (len(names) * np.bincount(target, minlength=len(names))))[target].astype(np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(target))
        for k in range(0, len(order), 64):
            at = order[k : k + 64]
            part = windows[at]
            n = len(part)
            columns = net._columns(part)
            response = columns @ net.filters
            where = response.argmax(axis=1)
            rows = np.arange(n)[:, None]
            pooled = response[rows, where, np.arange(n_filters)] + net.bias
            active = np.maximum(pooled, 0)
            error = _softmax(active @ net.out + net.out_bias)
            error[np.arange(n), target[at]] -= 1
            error *= weight[at, None] / n
            back = (error @ net.out.T) * (pooled > 0)
            chosen = columns[rows, where]  # n x filters x (widest * EMBED)
            d_filters = np.einsum("nfc,nf->cf", chosen, back) * within
            d_columns = back[:, :, None] * net.filters.T[None]
            bytes_ = _FOLD[np.pad(part, ((0, 0), (0, wide - 1)))]
            touched = np.stack([bytes_[rows, where + j] for j in range(wide)], axis=2)
            d_table = np.zeros_like(net.table)
            np.add.at(d_table, touched.ravel(), d_columns.reshape(-1, EMBED))
            step += 1
            for p, g, m, v in zip(held, [d_table, d_filters, back.sum(0), active.T @ error, error.sum(0)], first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def cut_windows(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all rows (the last of each padded by zeros), windows of each row, and bytes of each window."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = offsets[:-1][owner] + nth * WINDOW
    used = np.minimum(WINDOW, offsets[1:][owner] - begin)
    at = begin[:, None] + np.arange(WINDOW)
    windows = np.where(np.arange(WINDOW) < used[:, None], raw[np.minimum(at, max(0, len(raw) - 1))] if len(raw) else 0, 0).astype(np.uint8)
    return windows, counts, used


def held_out(doc_id: str = "doc_id", modulus: int = 3, remainder: int = 1) -> Column:
    """Whether crc32 of the id as text leaves the remainder; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def _window_sampler(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("label", pa.string()), ("window", pa.binary())])
    for batch in batches:
        labels, windows = [], []
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            body = text.encode()
            n = -(-len(body) // WINDOW)
            for k in sorted({i * n // WINDOWS_A_TEXT for i in range(WINDOWS_A_TEXT)}):
                labels.append(label)
                windows.append(body[k * WINDOW : (k + 1) * WINDOW])
        yield pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), pa.array(windows, pa.binary())], schema=schema)


def fit(labelled: DataFrame, sample_a_label: int = SAMPLE_A_LABEL) -> ByteCnn | None:
    """Train on doc_id, text and label; about sample_a_label documents of each label are read."""
    usable = labelled.where(F.col("label").isNotNull() & (F.octet_length(text_or_empty()) > 0))
    counts = {r.label: r.n for r in usable.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(MOST_LABELS).collect()}
    if not counts:
        return None
    share = F.lit(0)
    for label, n in counts.items():
        share = F.when(F.col("label") == label, F.lit(int(1e6 * min(1, sample_a_label / n)))).otherwise(share)
    picked = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < share).select("label", "text")
    # no more than the sample can hold if many rows repeat one id
    rows = in_batches(picked, _window_sampler, "label string, window binary").limit(4 * WINDOWS_A_TEXT * sample_a_label * len(counts)).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.label, bytes(r.window)))
    windows = np.zeros((len(rows), WINDOW), np.uint8)
    for i, r in enumerate(rows):
        windows[i, : len(r.window)] = np.frombuffer(bytes(r.window), np.uint8)
    net = train(windows, [r.label for r in rows])
    give_back()
    return net


def _predictor(net: ByteCnn | None) -> Callable:
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = to_buffer(batch.column(3))
            readable = batch.column(2).to_numpy(zero_copy_only=False)
            names, scores = [], []
            for a, b in chunks(offsets):
                if net is None:
                    names += [UNKNOWN] * (b - a)
                    scores += [0.0] * (b - a)
                    continue
                windows, counts, used = cut_windows(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                weighted = net.probabilities(windows) * used[:, None]
                total = np.zeros((len(counts) + 1, len(net.labels)))
                ends = np.cumsum(counts)
                running = np.concatenate([np.zeros((1, len(net.labels))), np.cumsum(weighted, axis=0, dtype=np.float64)])
                total = running[ends] - running[ends - counts]
                mean = total / np.maximum(1, np.diff(offsets[a : b + 1]))[:, None]
                best = mean.argmax(axis=1)
                ok = readable[a:b] & (counts > 0)
                names += [net.labels[k] if r else UNKNOWN for k, r in zip(best.tolist(), ok.tolist(), strict=True)]
                scores += np.where(ok, np.clip(mean.max(axis=1), 0, 1), 0.0).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], schema=schema)

    return run


def predict(docs: DataFrame, net: ByteCnn | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_or_empty().rlike(r"\p{L}").alias("readable"), text_or_empty().alias("text"))
    return in_batches(rows, _predictor(net), "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the documents that aren't held out, and predict for all."""
    labelled = docs.where(~held_out()).select("doc_id", "text", F.col("lang").alias("label"))
    return predict(docs, fit(labelled))


def _filterer(net: ByteCnn | None, least: float, text_at: int) -> Callable:
    predict_rows = _predictor(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, readable = pa.RecordBatch.from_struct_array(batch.column(0)), batch.column(1)
            none = pa.nulls(len(own), pa.int64())
            asked = pa.RecordBatch.from_arrays([none, readable, readable, own.column(text_at)], names=["doc_id", "held_out", "readable", "text"])
            for found in predict_rows(iter([asked])):
                good = np.array([n != UNKNOWN and s >= least for n, s in zip(found.column(2).to_pylist(), found.column(3).to_pylist(), strict=True)], bool)
                yield own.filter(pa.array(good))

    return run


def keep_identified(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows, with all their columns, whose language the network names with at least this score."""
    labelled = docs.where(~held_out()).select("doc_id", "text", F.col("lang").alias("label"))
    net = fit(labelled)
    # the rows' own columns stay in a struct, so none of their names can clash
    asked = docs.select(F.struct("*").alias("row"), text_or_empty().rlike(r"\p{L}").alias("readable"))
    return in_batches(asked, _filterer(net, least, docs.columns.index("text")), docs.schema)
