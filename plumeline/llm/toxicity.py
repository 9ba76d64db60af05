"""Toxic spans by a linear-chain conditional random field; document scores from its marginals.

Tokens are runs of letters, in lower case. Two states, clean and toxic, follow one another; a token's
evidence is the sum of hashed weights for itself, its neighbours and its first and last bytes. The field
is trained in numpy on labelled tokens and applied to whole texts: exact forward-backward recursions run
over many documents at once, and a document of any length is handled by composing the two-by-two
transfer matrices of its stretches.

Labels are given for documents, so tokens are labelled by a list of words and word beginnings that is
learnt first: they are added one at a time while they recur in enough toxic documents that no earlier
one marks, and in few clean ones. A calibrated logistic curve over the expected number and share of
toxic tokens (from the marginals) gives the document's score.

Training reads a bounded sample: at most SAMPLE labelled documents of each class, chosen by a hash, and
of those the ones of at most MOST_CHARS characters. Scoring reads every text whole.

Defined results: null and empty texts have no tokens and get the score of zero toxic tokens; without
labels of both classes every score is the toxic share of what labels there are (0 without any); a
document with several label rows is toxic if one says so; null labels are not learnt from; repeated rows
get equal results; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, give_back, in_batches, mix64, span_hashes, text_or_empty, to_buffer
from .language_id import held_out

#: Labelled documents of each class that training reads at most, and characters of each at most (longer ones are not learnt from).
SAMPLE, MOST_CHARS = 1000, 50_000
#: Bits of the weight table's index.
TABLE_BITS = 18
#: A learnt mark must mark this share of toxic documents that no earlier one marks, at least so many, and this much more often than clean ones.
LEAST_SHARE, LEAST_DOCS, LEAST_PRECISION = 0.01, 4, 0.75
#: Share of a document's tokens that a word or beginning must make up to mark it.
LEAST_DENSITY = 0.005
#: Bytes of the word beginnings that count as evidence.
HEADS = (4, 5, 6, 7)
STRETCH = 32
THRESHOLD = 0.3

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the runs of letters, and the first token of each row (one more ends the last)."""
    solid = _LETTER[raw]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    low = _FOLD[raw]
    return starts, ends, span_hashes(low, starts, ends), np.searchsorted(starts, offsets)


def _stems(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashed: np.ndarray) -> list[np.ndarray]:
    """Hashes of each token and of its first bytes, in several lengths (the whole token where it is shorter)."""
    low = _FOLD[raw]
    return [hashed, *(span_hashes(low, starts, np.minimum(starts + n, ends)) ^ np.uint64(n << 50) for n in HEADS)]


def features(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashed: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places in the weight table: one column each for the word, its first bytes, both neighbours and the last bytes."""
    n = len(starts)
    if not n:
        return np.zeros((0, 4 + len(HEADS)), np.int32)
    before, after = np.roll(hashed, 1), np.roll(hashed, -1)
    begins = first[:-1][first[:-1] < first[1:]]
    ends_at = first[1:][first[:-1] < first[1:]] - 1
    before[begins] = 0
    after[ends_at] = 0
    low = _FOLD[raw].astype(np.uint64)
    tail = low[ends - 1] | (low[np.maximum(ends - 2, starts)] << np.uint64(8)) | (low[np.maximum(ends - 3, starts)] << np.uint64(16))
    columns = (*_stems(raw, starts, ends, hashed), before, after, tail)
    return np.stack([mix64(x ^ np.uint64((k + 1) << 56)) >> np.uint64(64 - TABLE_BITS) for k, x in enumerate(columns)], axis=1).astype(np.int32)


def marginals(evidence: np.ndarray, change: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward messages of every token: the normalised pairs (alpha, beta).

    evidence: exp of the toxic state's score against the clean one's; change: 2x2 transition weights;
    first: each row's first token. Returns alpha0, alpha1, beta0, beta1 over all tokens.
    """
    counts = np.diff(first)
    pieces = -(-counts // STRETCH)
    n = int(pieces.sum())
    owner = np.repeat(np.arange(len(counts)), pieces)
    nth = np.arange(n) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = first[:-1][owner] + nth * STRETCH
    used = np.minimum(STRETCH, first[1:][owner] - begin)
    at = np.minimum(begin[:, None] + np.arange(STRETCH), max(0, len(evidence) - 1))
    inside = np.arange(STRETCH) < used[:, None]
    seen = evidence[at] if len(evidence) else np.ones((n, STRETCH))
    # transfer matrices of whole stretches, scaled to stay in range
    matrix = np.broadcast_to(np.eye(2), (n, 2, 2)).copy()
    for t in range(STRETCH):
        step = matrix @ change
        step[:, :, 1] *= seen[:, t, None]
        step /= step.sum(axis=(1, 2), keepdims=True)
        matrix = np.where(inside[:, t, None, None], step, matrix)
    alpha_in, beta_out = np.full((n, 2), 0.5), np.full((n, 2), 0.5)
    start = np.cumsum(pieces) - pieces
    order = np.argsort(-pieces, kind="stable")
    longest = int(pieces.max()) if len(pieces) else 0
    active = np.searchsorted(-pieces[order], -np.arange(1, longest + 1), side="right")
    for k in range(1, longest):
        rows = start[order[: active[k]]] + k
        message = np.einsum("ni,nij->nj", alpha_in[rows - 1], matrix[rows - 1])
        alpha_in[rows] = message / message.sum(axis=1, keepdims=True)
    for k in range(longest - 2, -1, -1):
        rows = start[order[: active[k + 1]]] + k
        message = np.einsum("nij,nj->ni", matrix[rows + 1], beta_out[rows + 1])
        beta_out[rows] = message / message.sum(axis=1, keepdims=True)
    alphas, betas = np.empty((n, STRETCH, 2)), np.empty((n, STRETCH, 2))
    now = alpha_in
    for t in range(STRETCH):
        step = now @ change
        step[:, 1] *= seen[:, t]
        step /= step.sum(axis=1, keepdims=True)
        now = np.where(inside[:, t, None], step, now)
        alphas[:, t] = now
    now = beta_out
    for t in range(STRETCH - 1, -1, -1):
        betas[:, t] = now
        step = now.copy()
        step[:, 1] *= seen[:, t]
        step = step @ change.T
        step /= step.sum(axis=1, keepdims=True)
        now = np.where(inside[:, t, None], step, now)
    return alphas[inside][:, 0], alphas[inside][:, 1], betas[inside][:, 0], betas[inside][:, 1]


@dataclass
class ToxicField:
    weights: np.ndarray
    bias: float
    change: np.ndarray  # exp of transition scores, [from, to]
    curve: np.ndarray  # logistic weights over curve_inputs
    marks: int

    def evidence(self, places: np.ndarray) -> np.ndarray:
        return np.exp(np.clip(self.weights[places].sum(axis=1) + self.bias, -30, 30))

    def toxic(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each token's probability of being toxic; its start and end; each row's first token."""
        starts, ends, hashed, first = tokens(raw, offsets)
        a0, a1, b0, b1 = marginals(self.evidence(features(raw, starts, ends, hashed, first)), self.change, first)
        return a1 * b1 / (a0 * b0 + a1 * b1), starts, ends, first

    def score(self, expected: np.ndarray, n_tokens: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-curve_inputs(expected, n_tokens) @ self.curve))


#: Inputs of the curve.
CURVE = 9


def curve_inputs(expected: np.ndarray, n_tokens: np.ndarray) -> np.ndarray:
    """A constant; how much of the expected toxic tokens falls in 0-1, 1-2, 2-3 and 3-6; and of their share of all tokens in parts of 3 %."""
    steps = [np.clip((expected - lo) / (hi - lo), 0, 1) for lo, hi in ((0, 1), (1, 2), (2, 3), (3, 6))]
    share = 100 * expected / np.maximum(n_tokens, 1)
    steps += [np.clip((share - lo) / (hi - lo), 0, 1) for lo, hi in ((0, 0.5), (0.5, 1), (1, 1.5), (1.5, 3))]
    return np.stack([np.ones(len(expected)), *steps], axis=1)


def expected_counts(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Expected toxic tokens of each row; what is far below certainty adds nothing however long the text."""
    running = np.concatenate([[0.0], np.cumsum(np.where(p > 0.05, p, 0.0))])
    return running[first[1:]] - running[first[:-1]]


def learn_marks(stems: list[np.ndarray], owner: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Hashes of words and word beginnings that recur in toxic documents, each for documents that no earlier one marks.

    A document is marked by what makes up at least two and LEAST_DENSITY of its tokens.
    """
    n_toxic, n_clean = int(toxic.sum()), int((~toxic).sum())
    tokens_of = np.bincount(owner, minlength=len(toxic))
    docs, marks = [], []
    for hashed in stems:
        order = np.lexsort((hashed, owner))
        own, own_hash = owner[order], hashed[order]
        edge = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (own_hash[1:] != own_hash[:-1])])) if len(own) else np.zeros(0, int)
        often = np.diff(np.append(edge, len(own))) >= np.maximum(2, LEAST_DENSITY * tokens_of[own[edge]])
        docs.append(own[edge][often])
        marks.append(own_hash[edge][often])
    doc, (name, mark) = np.concatenate(docs), np.unique(np.concatenate(marks), return_inverse=True)
    if not len(name):
        return name
    hits = np.bincount(mark, toxic[doc], minlength=len(name))
    rate = (hits + 0.5) / (n_toxic + 1)
    against = (np.bincount(mark, ~toxic[doc], minlength=len(name)) + 0.5) / (n_clean + 1)
    least = max(LEAST_DOCS, LEAST_SHARE * n_toxic)
    worth = np.where((hits >= least) & (rate / (rate + against) >= LEAST_PRECISION), np.log(rate / against), 0)
    open_, chosen = toxic.copy(), []
    while True:
        gain = np.bincount(mark, open_[doc], minlength=len(name))
        gain[worth == 0] = 0
        best = int(np.argmax(gain * worth))
        if gain[best] < least:
            return name[chosen]
        chosen.append(best)
        open_[doc[mark == best]] = False


def _places_of(raw: np.ndarray, offsets: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Features of the wanted tokens only, a part of the texts at a time."""
    out, before = None, 0
    for a, b in chunks(offsets, 1_000_000):
        part, at = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, hashed, first = tokens(part, at)
        inside = np.flatnonzero((wanted >= before) & (wanted < before + len(starts)))
        if len(inside):
            places = features(part, starts, ends, hashed, first)
            out = np.zeros((len(wanted), places.shape[1]), np.int32) if out is None else out
            out[inside] = places[wanted[inside] - before]
        before += len(starts)
    return out


def train(texts: list[str], toxic: np.ndarray, prior: float, rounds: int = 60, rate: float = 0.5, seed: int = 11) -> ToxicField:
    """Fit the field on token labels from learnt words, then the curve on document labels of share prior."""
    table = pa.array(texts, pa.large_string())
    raw, offsets = to_buffer(table)
    starts, ends, hashed, first = tokens(raw, offsets)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    stems = _stems(raw, starts, ends, hashed)
    marks = learn_marks(stems, owner, toxic)
    label = np.zeros(len(starts), bool)
    for each in stems:
        label |= np.isin(each, marks)
    # a mark counts in toxic documents where marks recur
    label &= toxic[owner] & (np.bincount(owner, label, minlength=len(texts)) >= 2)[owner]
    del stems
    # stretches of tokens: all around labelled tokens, and as many again from anywhere
    rng = np.random.default_rng(seed)
    length, hits = 24, np.flatnonzero(label)
    centres = np.concatenate([hits, rng.integers(0, max(1, len(label)), 2000 + len(hits))]) if len(label) else np.zeros(0, int)
    begin = np.unique(np.clip(centres - rng.integers(0, length, len(centres)), 0, max(0, len(label) - length)))
    begin = begin[owner[begin] == owner[np.minimum(begin + length - 1, len(owner) - 1)]] if len(begin) else begin
    weights, bias, logs = np.zeros(1 << TABLE_BITS), -3.0, np.log(np.array([[0.95, 0.05], [0.6, 0.4]]))
    field = ToxicField(weights, bias, np.exp(logs), np.zeros(CURVE), len(marks))
    squares, bias_square, log_square = np.full_like(weights, 1e-6), 1e-6, np.full((2, 2), 1e-6)
    if len(begin):
        at = (begin[:, None] + np.arange(length)).ravel()
        seen, wanted = _places_of(raw, offsets, at), label[at].astype(float)
        edges = np.arange(0, len(at) + 1, length)
        inner = np.ones(len(at), bool)
        inner[edges[:-1]] = False
        follow = np.flatnonzero(inner)
        true_pairs = np.array([[((wanted[follow - 1] == i) & (wanted[follow] == j)).sum() for j in (0, 1)] for i in (0, 1)])
        for _ in range(rounds):
            force = field.evidence(seen)
            a0, a1, b0, b1 = marginals(force, field.change, edges)
            p = a1 * b1 / (a0 * b0 + a1 * b1)
            slope = (wanted - p) / len(edges)
            push = np.bincount(seen.ravel(), np.repeat(slope, seen.shape[1]), minlength=len(weights)) - 1e-5 * weights
            squares += push**2
            weights += rate * push / np.sqrt(squares)
            bias_push = slope.sum()
            bias_square += bias_push**2
            bias += rate * bias_push / np.sqrt(bias_square)
            pair = np.empty((2, 2, len(follow)))
            for i, a in enumerate((a0, a1)):
                for j, b in enumerate((b0, b1)):
                    pair[i, j] = a[follow - 1] * field.change[i, j] * b[follow] * (force[follow] if j else 1)
            log_push = (true_pairs - (pair / pair.sum(axis=(0, 1))).sum(axis=2)) / len(edges)
            log_square += log_push**2
            logs = logs + 0.1 * log_push / np.sqrt(log_square)
            field.bias, field.change = float(bias), np.exp(logs - logs.max())
    inputs = []
    for a, b in chunks(offsets):
        p, _, _, own = field.toxic(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        inputs.append(curve_inputs(expected_counts(p, own), np.diff(own)))
    inputs = np.concatenate(inputs)
    weight = np.where(toxic, prior / max(1, toxic.sum()), (1 - prior) / max(1, (~toxic).sum()))
    weight = weight / weight.sum() * len(texts)
    curve = np.zeros(inputs.shape[1])
    curve[0] = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    for _ in range(30):  # Newton's steps of a lightly regularised logistic regression
        q = 1 / (1 + np.exp(-inputs @ curve))
        slope = inputs.T @ (weight * (toxic - q)) - 0.5 * curve * (np.arange(len(curve)) > 0)
        bend = (inputs * (weight * q * (1 - q))[:, None]).T @ inputs + np.diag([1e-6] + [0.5] * (len(curve) - 1))
        curve = curve + np.linalg.solve(bend, slope)
    field.curve = curve
    return field


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicField | float:
    """Train on at most sample labelled documents of each class; a plain share where a class is missing."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        return float(counts.get(1, 0) > 0) if total else 0.0
    order = F.xxhash64("doc_id", F.lit(23))
    picked = [known.where(F.col("toxic") == c).orderBy(order, "doc_id").limit(sample) for c in (0, 1)]
    # 2 * sample rows of two numbers at most
    chosen = F.broadcast(picked[0].unionByName(picked[1]))
    rows = docs.select("doc_id", text_or_empty().alias("text")).where(F.length("text") <= MOST_CHARS).join(chosen, "doc_id").select("doc_id", "text", "toxic").limit(4 * sample).collect()
    rows.sort(key=lambda r: (r.doc_id, r.text))
    toxic = np.array([r.toxic == 1 for r in rows], bool)
    prior = counts.get(1, 0) / total
    if not toxic.any() or toxic.all():
        return prior
    field = train([r.text for r in rows], toxic, prior)
    give_back()
    return field


_SCHEMA = "doc_id long, held_out boolean, score double, predicted int, toxic_tokens double, spans string"


def _scorer(field: ToxicField | float) -> Callable:
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("toxic_tokens", pa.float64()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = to_buffer(batch.column(2))
            for a, b in chunks(offsets):
                part, at = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                spans = [""] * (b - a)
                if isinstance(field, float):
                    expected, scores = np.zeros(b - a), np.full(b - a, field)
                else:
                    p, starts, ends, first = field.toxic(part, at)
                    expected = expected_counts(p, first)
                    scores = field.score(expected, np.diff(first))
                    hits = np.flatnonzero(p > 0.5)
                    if len(hits):
                        # code points before each byte: those that don't continue a character
                        chars = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
                        rows = np.searchsorted(first, hits, side="right") - 1
                        for row, s, e in zip(rows.tolist(), chars[starts[hits]], chars[ends[hits]], strict=True):
                            base = chars[at[row]]
                            spans[row] += ("," if spans[row] else "") + f"{s - base}:{e - base}"
                predicted = (scores >= THRESHOLD).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], *map(pa.array, (scores, predicted, expected)), pa.array(spans, pa.string())], schema=schema)

    return run


def score(docs: DataFrame, field: ToxicField | float) -> DataFrame:
    """doc_id, held_out, score, predicted, the expected number of toxic tokens, and their spans (start:end in code points)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(modulus=4, remainder=2).alias("held_out"), text_or_empty().alias("text"))
    return in_batches(rows, _scorer(field), _SCHEMA)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labels of documents that aren't held out, and score all documents."""
    return score(docs, fit(docs, labels.where(~held_out(modulus=4, remainder=2))))
