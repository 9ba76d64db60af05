"""Token ids from public tokenizer files, with each distinct piece of text encoded once per worker.

A text is cut only where the tokenizer is certain to start a new pre-token whatever stands around it
(before white space, and where letters, digits and other marks meet), so encoding the pieces one by one
gives the ids of the whole. Pieces are found and compared in numpy over code points; only pieces that a
worker has not met lately reach the tokenizers library. Most are at most 16 characters of Latin-1, which
two numbers hold in full: one look into a table and one comparison find such a piece. The others are found
by a hash and compared point by point. The piece memory is bounded and holds no state that changes a result.

Literal special tokens in a text, such as <|endoftext|>, are spelt out like other text, or with special_ids
are their single ids, as the tokenizer's own encode gives them: texts are then cut at these tokens first.
"""

from __future__ import annotations

import os
import re
import unicodedata
from functools import cache
from itertools import chain

import numpy as np

#: Pieces that a worker keeps; beyond this it starts anew.
MEMO_PIECES = 400_000
#: Code points in one numpy pass.
PASS_POINTS = 1_000_000
#: Places of the table of short pieces, as a power of two; a piece whose place is taken is found by its hash.
TABLE_BITS = 20

_OPAQUE, _SPACE, _LETTER, _DIGIT, _OTHER = 0, 1, 2, 3, 4


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _kind(ch: str) -> int:
    """A class that old and new Unicode tables agree on and that lower case and NFC keep, else opaque."""
    new, old = unicodedata.category(ch), unicodedata.ucd_3_2_0.category(ch)
    low = ch.lower()
    if new != old or len(low) != 1 or unicodedata.normalize("NFC", low) != low or unicodedata.combining(ch):
        return _OPAQUE
    if ch in " \t\n\x0b\x0c\r":
        return _SPACE
    if ch.isspace() or new[0] in "MCZ":
        return _OPAQUE
    if unicodedata.category(low)[0] != new[0] or unicodedata.normalize("NFC", ch) != ch:
        return _OPAQUE
    return {"L": _LETTER, "N": _DIGIT}.get(new[0], _OTHER)


@cache
def _kinds() -> np.ndarray:
    """Classes of the code points below U+3000; those above are opaque."""
    return np.array([_kind(chr(c)) for c in range(0x3000)] + [_OPAQUE], dtype=np.uint8)


@cache
def _lower() -> np.ndarray:
    """Lower case of the code points below U+3000 that are not opaque; others stay."""
    kinds = _kinds()
    return np.array([ord(chr(c).lower()) if kinds[c] != _OPAQUE else c for c in range(0x3000)], dtype=np.uint32)


@cache
def _latin() -> tuple[bytes, bytes]:
    """Classes and lower case of the code points of Latin-1, for bytes.translate."""
    return _kinds()[:256].tobytes(), _lower()[:256].astype(np.uint8).tobytes()


@cache
def _byte_letters() -> dict[int, str]:
    """The characters that byte-level vocabularies write for the bytes: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _piece_starts(points: np.ndarray, kind: np.ndarray, spaced: bool) -> np.ndarray:
    """Where a cut is safe: True at the first code point of each piece.

    spaced: white space is part of tokens; otherwise the tokenizer drops it, and a cut after it is safe too.
    """
    left, right = kind[:-1], kind[1:]
    known = (left != _OPAQUE) & (right != _OPAQUE)
    # before white space; where letters, digits and marks meet, but never just after an apostrophe
    safe = known & (left != _SPACE) & (left != right) & (points[:-1] != 39)
    safe |= known & (left != _SPACE) & (right == _SPACE)
    start = np.ones(len(points), dtype=bool)
    start[1:] = safe
    # after a lone white space other than U+0020, which is a token of its own
    lone = known & (left == _SPACE) & (right != _SPACE) & (points[:-1] != 32)
    lone[1:] &= kind[:-2] != _SPACE
    lone[1:] &= kind[:-2] != _OPAQUE
    lone[:1] = False
    start[1:] |= lone
    if not spaced:
        start[1:] |= known & (left == _SPACE) & (right != _SPACE)
    return start


class Encoder:
    """encode(texts) gives all ids, joined, and the number of ids of each text."""

    def __init__(self, path: str, special_ids: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        ids = lambda t: self._tokenizer.encode(t, add_special_tokens=False).ids
        # what the tokenizer itself does with white space and case
        self._spaced, self._folds = ids(" a") != ids("a"), ids("AB") == ids("ab")
        self._drops = not any(ids(c) for c in " \t\n\x0b\x0c\r")
        added = self._tokenizer.get_added_tokens_decoder() if special_ids else {}
        self._added = {t.content: i for i, t in added.items()}
        # the tokenizer takes the longest of the tokens that start at a place
        self._cuts = re.compile("(" + "|".join(re.escape(c) for c in sorted(self._added, key=len, reverse=True)) + ")")
        # tokens that take in white space, match after normalising or stand as words only are left to the library
        self._whole = any(not t.special or t.normalized or t.single_word or t.lstrip or t.rstrip for t in added.values())
        if self._whole:
            self._tokenizer.encode_special_tokens = False
        self._forget()

    def _forget(self) -> None:
        # pieces by their hash, in order; the ids and the code points of each piece, one after another
        self._hashes, self._entries = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._ids, self._points = _Pool(), _Pool()
        # entry 0 is no piece; the characters of a short piece stand in its two numbers, which are 0 for other pieces
        self._ids.add(np.zeros(0, np.uint32), np.zeros(1, np.int64))
        self._points.add(np.zeros(0, np.uint32), np.zeros(1, np.int64))
        self._numbers, self._table = np.zeros((2, 1), np.uint64), np.zeros(1 << TABLE_BITS, np.int32)

    def _learn(self, pieces: list[str], words: list[bool]) -> None:
        """words: whether a piece is letters only, with one space before them at most, and so a single pre-token."""
        other = [p for p, w in zip(pieces, words, strict=True) if not w]
        rest = iter(self._tokenizer.encode_batch_fast(other, add_special_tokens=False)) if other else iter(())
        model, letters = self._tokenizer.model, _byte_letters()
        found = [[t.id for t in model.tokenize(p if p.isascii() and p.isalpha() else p.encode().decode("latin-1").translate(letters))] if w else next(rest).ids for p, w in zip(pieces, words, strict=True)]
        self._ids.add(np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, count=len(found)))
        self._points.add(np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32), np.fromiter(map(len, pieces), np.int64, count=len(pieces)))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self._whole:
            return self._plainly(texts)
        # text and added token in turn, text first and last
        split = [self._cuts.split(t) if any(c in t for c in self._added) else [t] for t in texts]
        ids, counts = self._between([p for own in split for p in own[::2]])
        if len(counts) == len(texts):
            return ids, counts
        sizes = np.fromiter((len(own) // 2 + 1 for own in split), np.int64, count=len(split))
        last = np.cumsum(sizes) - 1
        added = [self._added[c] for own in split for c in own[1::2]]
        ids = np.insert(ids, np.delete(np.cumsum(counts), last), np.array(added, ids.dtype))
        return ids, np.add.reduceat(counts, last + 1 - sizes) + sizes - 1

    def _between(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if any(len(t) > 2 * PASS_POINTS for t in texts):
            # very long texts go in parts that end where a cut is safe
            parts = [self._parts(t) for t in texts]
            ids, counts = self._encode_all([p for own in parts for p in own])
            ends = np.cumsum([len(own) for own in parts])
            total = np.concatenate([[0], np.cumsum(counts)])
            return ids, np.diff(total[np.concatenate([[0], ends])])
        return self._encode_all(texts)

    def _encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts, start = [], [], 0
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        ends = np.cumsum(lengths)
        while start < len(texts):
            base = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, base + PASS_POINTS, side="right")))
            part_ids, part_counts = self._encode(texts[start:end], lengths[start:end])
            ids.append(part_ids)
            counts.append(part_counts)
            start = end
        return (np.concatenate(ids), np.concatenate(counts)) if ids else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _parts(self, text: str) -> list[str]:
        out, at, reach = [], 0, PASS_POINTS
        while len(text) - at > reach:
            begin = at + reach - min(4096, reach // 2)
            window = np.frombuffer(text[begin : at + reach].encode("utf-32-le"), dtype=np.uint32)
            safe = np.flatnonzero(_piece_starts(window, _kinds()[np.minimum(window, 0x3000)], self._spaced))
            safe = safe[safe > 2]  # the first places lack what stands before them
            if len(safe):
                out.append(text[at : begin + int(safe[-1])])
                at, reach = begin + int(safe[-1]), PASS_POINTS
            else:
                reach += PASS_POINTS
        return [*out, text[at:]]

    def _encode(self, texts: list[str], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        joined = "".join(texts)
        if not joined:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        if len(self._hashes) > MEMO_PIECES:
            self._forget()
        points, kind, joined = self._classes(joined)
        begins = np.concatenate([[0], np.cumsum(lengths)])
        mark = _piece_starts(points, kind, self._spaced)
        mark[begins[:-1][begins[:-1] < len(points)]] = True
        starts = np.flatnonzero(mark)
        ends = np.append(starts[1:], len(points))
        if self._drops:
            # a lone white space gives no id
            some = (kind[starts] != _SPACE) | (ends - starts > 1)
            starts, ends = starts[some], ends[some]
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        hashes, numbers = _names(points, starts, ends)
        entry = self._table[hashes >> np.uint64(64 - TABLE_BITS)].astype(np.int64)
        rest = np.flatnonzero((numbers[0] == 0) | (self._numbers[0][entry] != numbers[0]) | (self._numbers[1][entry] != numbers[1]))
        if len(rest):
            found = self._entries_of(joined, points, kind, starts[rest], ends[rest], hashes[rest], numbers[:, rest])
            if found is None:
                return self._plainly(texts)
            entry[rest] = found
        begin, sizes = self._ids.ends[entry], self._ids.ends[entry + 1] - self._ids.ends[entry]
        total = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(begin - total[:-1], sizes) + np.arange(total[-1])
        return self._ids.values[at], np.diff(total[np.searchsorted(starts, begins)])

    def _classes(self, joined: str) -> tuple[np.ndarray, np.ndarray, str]:
        """Code points in the tokenizer's case, their classes, and the text in that case."""
        try:
            raw = joined.encode("latin-1")
        except UnicodeEncodeError:
            points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
            small = np.minimum(points, 0x3000)
            kind = _kinds()[small]
            if self._folds:
                points = np.where(points < 0x3000, _lower()[np.minimum(small, 0x2FFF)], points)
                joined = points.tobytes().decode("utf-32-le")
            return points, kind, joined
        kinds, lower = _latin()
        kind = np.frombuffer(raw.translate(kinds), np.uint8)
        if self._folds:
            raw = raw.translate(lower)
            joined = raw.decode("latin-1")
        return np.frombuffer(raw, np.uint8), kind, joined

    def _entries_of(self, joined: str, points: np.ndarray, kind: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, numbers: np.ndarray) -> np.ndarray | None:
        """The entry of each piece, by its hash; new pieces are learnt. None if two pieces share a hash."""
        found, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if not _same(points, starts, ends, points, starts[first][which], ends[first][which]):
            return None
        at = np.searchsorted(self._hashes, found)
        known = np.zeros(len(found), bool)
        known[at < len(self._hashes)] = self._hashes[at[at < len(self._hashes)]] == found[at < len(self._hashes)]
        entry = np.empty(len(found), np.int64)
        entry[known] = self._entries[at[known]]
        old, at_known = entry[known], first[known]
        if not _same(points, starts[at_known], ends[at_known], self._points.values, self._points.ends[old], self._points.ends[old + 1]):
            return None
        new = np.flatnonzero(~known)
        if len(new):
            begin, end = starts[first[new]], ends[first[new]]
            spaced = (points[begin] == 32) & (end - begin > 1)
            letters = np.concatenate([[0], np.cumsum(kind[_places(begin, end)] == _LETTER)])
            sizes = end - begin
            last = np.cumsum(sizes)
            word = letters[last] - letters[last - sizes] == sizes - spaced
            entry[new] = len(self._ids.ends) - 1 + np.arange(len(new))
            self._learn([joined[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)], word.tolist())
            self._hashes, self._entries = np.insert(self._hashes, at[new], found[new]), np.insert(self._entries, at[new], entry[new])
            added = numbers[:, first[new]]
            self._numbers = np.concatenate([self._numbers, added], axis=1)
            place = found[new] >> np.uint64(64 - TABLE_BITS)
            free = (added[0] != 0) & (self._table[place] == 0)
            self._table[place[free]] = entry[new][free]
        return entry[which]

    def _plainly(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, count=len(found))


class _Pool:
    """Numbers of many entries one after another; entry k is values[ends[k]:ends[k + 1]]."""

    def __init__(self) -> None:
        self.values, self.ends = np.zeros(1 << 16, np.uint32), np.zeros(1, np.int64)

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        used = int(self.ends[-1])
        self.ends = np.concatenate([self.ends, used + np.cumsum(sizes)])
        while len(self.values) < used + len(values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        self.values[used : used + len(values)] = values


def _places(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The places of all pieces, one piece after another."""
    sizes = ends - starts
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def _same(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, others: np.ndarray, other: np.ndarray, other_ends: np.ndarray) -> bool:
    """Whether each piece of points has the very code points of its counterpart in others."""
    if not np.array_equal(ends - starts, other_ends - other):
        return False
    return bool(np.array_equal(points[_places(starts, ends)], others[_places(other, other_ends)]))


#: By the number of characters, the bits that they take of a number of eight.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def _names(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each piece, and two numbers that hold its characters if it is short: at most 16, all from U+0001 to U+00FF. They are 0 for other pieces."""
    from .common import mix64, span_hashes

    raw = np.zeros(len(points) + 16, np.uint8)
    raw[: len(points)] = points if points.dtype == np.uint8 else points & 0xFF
    eight = np.ndarray(len(points) + 9, "<u8", raw, 0, (1,))  # the eight bytes from each place on
    sizes = ends - starts
    numbers = np.zeros((2, len(starts)), np.uint64)
    numbers[0] = eight[starts] & _FIRST[np.minimum(sizes, 8)]
    beyond = np.flatnonzero(sizes > 8)
    numbers[1, beyond] = eight[starts[beyond] + 8] & _FIRST[np.minimum(sizes[beyond] - 8, 8)]
    hashes = mix64(numbers[0])
    hashes[beyond] = mix64(hashes[beyond] + numbers[1, beyond])
    other = sizes > 16
    odd = np.flatnonzero((points == 0) | (points > 255) if points.dtype != np.uint8 else points == 0)
    other[np.searchsorted(starts, odd, side="right") - 1] = True
    other = np.flatnonzero(other)
    numbers[:, other] = 0
    lasts = np.cumsum(sizes[other])
    hashes[other] = span_hashes(points[_places(starts[other], ends[other])], lasts - sizes[other], lasts)
    return hashes, numbers


@cache
def encoder(path: str, special_ids: bool = False) -> Encoder:
    """One encoder for each worker and file."""
    return Encoder(path, special_ids)
