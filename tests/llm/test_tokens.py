import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from plumeline.llm import packing, token_files, token_rollup, tokenization
from plumeline.llm.tokenization import Encoder, tokenizer_path

SCHEMA = "doc_id long, text string, source string, lang string, ids string"
TEXTS = [None, "", "Hello, world!  It's 1234\n\n\tfine.", "İstanbul é é 中文字 ½ ٣ <|endoftext|>", "word " * 3000, "a", "a", "'s 'S x'll $$$'re"]


def plain(name):
    t = Tokenizer.from_file(tokenizer_path(name))
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_ids_of_whole_texts(name):
    rng = random.Random(1)
    letters = [*"ab'1. \n\t,sé́İ中 ½$ß", "'s", "'ll", "THE"]
    texts = [t or "" for t in TEXTS] + ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(4000)]
    encoder = Encoder(tokenizer_path(name))
    for _ in range(2):
        ids, counts = encoder.encode(texts)
        expected = plain(name)(texts)
        assert counts.tolist() == [len(x) for x in expected]
        assert ids.tolist() == [i for x in expected for i in x]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_very_long_texts_go_in_parts(name, monkeypatch):
    monkeypatch.setattr(tokenization, "PASS_POINTS", 200)
    rng = random.Random(2)
    texts = ["".join(rng.choices([*"ab'1. \n\té中", " the", "'s"], k=3000)), "x" * 5000, "", "short one", "é中" * 900]
    ids, counts = Encoder(tokenizer_path(name)).encode(texts)
    expected = plain(name)(texts)
    assert counts.tolist() == [len(x) for x in expected] and ids.tolist() == [i for x in expected for i in x]


def test_best_fit_finds_the_tightest_window():
    lengths = np.array([5, 7, 3, 4, 1, 10])
    where, offset, n = packing.best_fit(lengths, 10)
    # 10 | 7+3 | 5+4+1
    assert n == 3
    assert where.tolist() == [2, 1, 1, 2, 2, 0] and offset.tolist() == [0, 0, 7, 5, 9, 0]
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 64, 500)
    where, offset, n = packing.best_fit(lengths, 64)
    room = {}
    for i in np.argsort(-lengths, kind="stable"):
        fits = {r for r in room.values() if r >= lengths[i]}
        assert room.get(where[i], 64) == (min(fits) if fits else 64)
        room[where[i]] = room.get(where[i], 64) - lengths[i]
    assert lengths.sum() / (64 * n) > 0.9


def test_pack_round_trip(spark):
    rows = [(i, t, "s", "l", "clash") for i, t in enumerate(TEXTS)] + [(None, "null id", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    pieces = packing.pack(df, tokenizer_path("byte_bpe_50k.json"), with_ids=True)
    got = pieces.collect()
    for doc_id, text, *_ in rows:
        expected = plain("byte_bpe_50k.json")([text])[0] + [0]
        own = sorted((p for p in got if p.doc_id == doc_id), key=lambda p: p.start)
        assert [i for p in own for i in p.ids] == expected
        assert all(p.doc_tokens == len(expected) and p.length == len(p.ids) and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) for p in own)
    filled = {}
    for p in got:
        filled.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for spans in filled.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    assert all(len(r.ids) == 1024 for r in packing.sequences(pieces).collect())
    assert packing.pack(df.limit(0), tokenizer_path("byte_bpe_50k.json")).collect() == []


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(3)
    for ids in (np.zeros(0, np.uint32), np.array([7], np.uint32), np.full(1000, 5, np.uint32), rng.integers(0, 30, 20_000).astype(np.uint32), np.tile(rng.integers(0, 900, 50), 80).astype(np.uint32)):
        base = int(ids.max()) + 1 if len(ids) else 1
        coded = token_files.repair(ids, base, rounds=6, rules_a_round=64, min_count=2)
        assert token_files.expand(*coded, base).tolist() == ids.tolist()
        for start, stop in ((0, len(ids)), (3, 11), (len(ids) // 2, len(ids) // 2 + 5)):
            assert token_files.token_range(*coded, base, start, stop).tolist() == ids[start:stop].tolist()
    assert len(coded[2]) < len(ids) / 4


def test_token_files_round_trip(spark, tmp_path):
    rows = [(len(TEXTS) - i, t, "s", "l", "clash") for i, t in enumerate(TEXTS)] + [(3, "repeat", None, None, None)] * 2
    df = spark.createDataFrame(rows, SCHEMA)
    token_files.write(df, str(tmp_path / "f"), tokenizer_path("word_bpe_49k.json"), block_tokens=500, partitions=3)
    got = token_files.read(spark, str(tmp_path / "f"), with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(r[0] for r in rows)
    at, encode = 0, plain("word_bpe_49k.json")
    left = [(r[0], encode([r[1]])[0] + [1]) for r in rows]
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids)
        left.remove((r.doc_id, r.ids))
        at += r.n_tokens
    token_files.write(df.limit(0), str(tmp_path / "e"), tokenizer_path("word_bpe_49k.json"))
    assert token_files.read(spark, str(tmp_path / "e")).collect() == []


def test_rollup_of_signed_deltas(spark, tmp_path):
    rows = [(i, t, None if i == 2 else f"s{i % 2}", "en", "x") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, SCHEMA)
    count = lambda d: token_rollup.count_tokens(d, tokenizer_path("byte_bpe_50k.json"), "v1")
    sizes = [len(x) for x in plain("byte_bpe_50k.json")(TEXTS)]
    totals = lambda r: {(x.source, x.lang, x.tokenizer): (x.docs, x.tokens) for x in r.totals().collect()}

    def expected(sizes, gone=()):
        out = {}
        for i, n in enumerate(sizes):
            if i not in gone:
                k = (None if i == 2 else f"s{i % 2}", "en", "v1")
                out[k] = (out.get(k, (0, 0))[0] + 1, out.get(k, (0, 0))[1] + n)
        return out

    rollup = token_rollup.TokenRollup(spark, str(tmp_path / "r"))
    assert rollup.totals().collect() == []
    assert rollup.commit("a", token_rollup.inserts(count(df)))
    assert not rollup.commit("a", token_rollup.inserts(count(df)))
    assert totals(rollup) == expected(sizes)
    rollup.commit("b", token_rollup.deletes(count(df.where("doc_id = 4"))))
    assert totals(rollup) == expected(sizes, {4})
    rollup.compact()
    assert totals(rollup) == expected(sizes, {4}) and not rollup.commit("b", token_rollup.deletes(count(df)))
    old = df.where("doc_id = 5")
    rollup.commit("c", token_rollup.revisions(count(old), count(old.withColumn("text", old.text.substr(1, 0)))))
    assert totals(rollup) == expected([*sizes[:5], 0, *sizes[6:]], {4})
    rollup.commit("d", token_rollup.inserts(count(df.limit(0))))
    assert totals(rollup) == expected([*sizes[:5], 0, *sizes[6:]], {4})
