import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from plumeline.llm import queries, tokenization
from plumeline.llm.tokenization import Encoder, tokenizer_path

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
TEXTS = ["one <|endoftext|> two", "<|endoftext|>", "<|startoftext|>a<|endoftext|><|endoftext|>", "plain words", "", None, "<|ENDOFTEXT|> <|endoftext <|endoftext|>|>", "x'<|endoftext|>s\n\n<|endoftext|>\t y " * 40]


def plain(name):
    """The contract: the tokenizer as it is."""
    t = Tokenizer.from_file(tokenizer_path(name))
    return lambda texts: [t.encode(x or "", add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("name", NAMES)
def test_ids_of_an_unmodified_tokenizer(name, monkeypatch):
    assert plain("byte_bpe_50k.json")(TEXTS[:1]) == [[505, 220, 50256, 734]]
    rng = random.Random(5)
    marks = ["<|endoftext|>", "<|startoftext|>", "<|", "|>", "<|EndOfText|>", *"ab'1. \n\t,éİ中", "the", "'s"]
    texts = [t or "" for t in TEXTS] + ["".join(rng.choices(marks, k=rng.randint(0, 30))) for _ in range(2000)]
    expected = plain(name)(texts)
    for points in (1_000_000, 50):
        monkeypatch.setattr(tokenization, "PASS_POINTS", points)
        ids, counts = Encoder(tokenizer_path(name), special_ids=True).encode(texts)
        assert counts.tolist() == [len(x) for x in expected] and ids.tolist() == [i for x in expected for i in x]
    assert [a.tolist() for a in Encoder(tokenizer_path(name), special_ids=True).encode([])] == [[], []]


def test_queries_count_special_tokens_once(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, "s", "en") for i, t in enumerate(TEXTS)], "doc_id long, text string, source string, lang string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    byte, word = (plain(n)(TEXTS) for n in NAMES)
    crc = {i: zlib.crc32(np.array([*x, 0], "<u4").tobytes()) for i, x in enumerate(byte)}
    for pieces in (queries.op4_packing(spark, str(tmp_path)), corpus_pipeline.pack_sequences(spark, docs, str(tmp_path))):
        assert {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in pieces.collect()} == {i: (len(x) + 1, crc[i]) for i, x in enumerate(byte)}
    (total,) = queries.op5_token_rollup(spark, str(tmp_path)).collect()
    assert total.tokens == sum(map(len, byte))
    at = 0
    for r in queries.op10_token_files(spark, str(tmp_path)).orderBy("start").collect():
        assert (r.start, r.n_tokens) == (at, len(word[r.doc_id]) + 1)
        at += r.n_tokens
    assert at == sum(len(x) + 1 for x in word)
