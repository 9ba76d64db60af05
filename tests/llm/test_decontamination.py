import numpy as np
from pyspark.sql import functions as F

from plumeline.llm import decontaminate


def test_the_basis_is_fitted_on_all_documents(spark, monkeypatch):
    n = 30_000
    words = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda j: F.concat(F.lit("w"), (F.pmod(F.xxhash64("id", j), F.lit(37)) * F.pmod(F.col("id"), F.lit(53))).cast("string")))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 1000 != 5, F.array_join(words, " ")).alias("text")).repartition(7)
    idf = decontaminate.inverse_frequencies(docs)
    given, svd = [], np.linalg.svd
    monkeypatch.setattr(np.linalg, "svd", lambda x, **how: given.append(x) or svd(x, **how))
    basis = decontaminate.latent_basis(docs, idf)
    # the same by hand, from all texts
    texts = [r.text.encode() for r in docs.where("text is not null").collect()]
    hashed, first = decontaminate.word_hashes(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    bucket, owner = decontaminate._buckets(hashed), np.repeat(np.arange(len(texts)), np.diff(first))
    width = given[0].shape[1]
    random = np.random.default_rng(5).normal(size=(decontaminate.BUCKETS, width)).astype(np.float32)
    rows, product = np.zeros((len(texts), width)), np.zeros((decontaminate.BUCKETS, width))
    np.add.at(rows, owner, random[bucket] * idf[bucket][:, None])
    np.add.at(product, bucket, rows[owner] * idf[bucket][:, None])
    assert np.allclose(given[0], product, rtol=1e-3, atol=1e-3 * np.abs(product).max())
    assert basis.shape == (decontaminate.BUCKETS, decontaminate.DIMENSIONS)
    assert np.allclose(basis.T @ basis, np.eye(decontaminate.DIMENSIONS), atol=1e-3)
