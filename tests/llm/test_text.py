import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from plumeline.llm import common, decontaminate, language_id, near_dedup, pii, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, score string"


def invented(rng, syllables, n):
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n))


def edges():
    return [(10_001, None, None, None, None), (10_002, "", "xx", "s", "s"), (10_003, "123 !!", "xx", "s", "s"), (10_004, "thering " * 30_000, None, None, None), (None, "thering and", "en", None, None), (10_005, "thering", None, None, None), (10_005, "thering", None, None, None)]


def test_language_on_held_out_rows(spark):
    rng = random.Random(4)
    kinds = {"en": ["the", "ing", "and", "er"], "de": ["sch", "ung", "eit", "ü"], "fr": ["eau", "oi", "é", "ment"]}
    rows = [(i, invented(rng, kinds[k], rng.randint(20, 200)), k, "s", "s") for i, k in enumerate(rng.choices(list(kinds), k=300))]
    df = spark.createDataFrame(rows + edges(), SCHEMA)
    got = language_id.identify(df).collect()
    by = {r.doc_id: r for r in got}
    held = [i for i, *_ in rows if by[i].held_out]
    assert 60 < len(held) < 140 and np.mean([by[i].lang_pred == rows[i][2] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got) and len(got) == len(rows) + 7
    assert [by[i].lang_pred for i in (10_001, 10_002, 10_003)] == ["und"] * 3 and by[10_004].lang_pred == "en"
    kept = language_id.keep_identified(df)
    assert kept.columns == df.columns and kept.where("doc_id in (10001, 10002, 10003)").count() == 0
    assert kept.count() == len(rows) + 4
    assert language_id.identify(df.limit(0)).collect() == []
    assert {r.lang_pred for r in language_id.identify(df.where("lang is null")).collect()} == {"und"}


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(500):
        words = invented(rng, ["the", "ing", "an", "o"], rng.randint(40, 200)).split()
        bad = i % 5 == 0
        if bad:
            for _ in range(max(3, len(words) // 30)):
                words.insert(rng.randrange(len(words)), rng.choice(["Idiot,", "moron", "SCUM!"]))
        rows.append((i, " ".join(words), "en", "s", "s"))
        labels.append((i, 1, int(bad), "x"))
    labels += [(None, 1, 1, "x"), (3, 1, None, "x")]
    df = spark.createDataFrame(rows + edges(), SCHEMA)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    got = toxicity.score_toxicity(df, lab).collect()
    by = {r.doc_id: r for r in got}
    held = [i for i in range(500) if by[i].held_out]
    assert 80 < len(held) < 170 and all(by[i].predicted == (i % 5 == 0) for i in held)
    assert all(0 <= r.score <= 1 for r in got) and len(got) == 507
    spans = [tuple(map(int, s.split(":"))) for s in by[0].spans.split(",")]
    assert {rows[0][1][a:b].lower() for a, b in spans} <= {"idiot", "moron", "scum"} and spans
    assert {r.score for r in toxicity.score_toxicity(df, lab.limit(0)).collect()} == {0.0}
    assert toxicity.score_toxicity(df.limit(0), lab).collect() == []


def test_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 9):
        force, change = rng.uniform(0.1, 5, n), rng.uniform(0.1, 1, (2, 2))
        a0, a1, b0, b1 = toxicity.marginals(force, change, np.array([0, n, n]))
        p = a1 * b1 / (a0 * b0 + a1 * b1)
        total = np.zeros(2)
        on = np.zeros(n)
        for path in range(2**n):
            s = [(path >> k) & 1 for k in range(n)]
            w = 0.5 * (change[0, s[0]] + change[1, s[0]])
            for k in range(n):
                w *= (force[k] if s[k] else 1) * (change[s[k - 1], s[k]] if k else 1)
            total[0] += w
            on += w * np.array(s)
        assert np.allclose(p, on / total[0])
    # long rows are composed from stretches
    force, change = rng.uniform(0.1, 5, 1000), rng.uniform(0.1, 1, (2, 2))
    whole = toxicity.marginals(force, change, np.array([0, 300, 300, 1000]))
    part = toxicity.marginals(force[300:], change, np.array([0, 700]))
    assert all(np.allclose(x[300:], y) for x, y in zip(whole, part, strict=True))


def test_closures_stay_small_after_training():
    common.span_hashes(np.zeros(3_000_000, np.uint8), np.array([0]), np.array([5]))
    runs = [toxicity._scorer(0.1), language_id._predictor(None), decontaminate._counter, near_dedup._featurer(2), near_dedup._confirmer(2, 80), language_id._window_sampler]
    assert max(len(cloudpickle.dumps(common.trimmed(run))) for run in runs) < 20_000
    common.give_back()


def brute_pii(t):
    digits = lambda x: re.sub(r"[^0-9]", "", x)
    luhn = lambda s: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0
    find = lambda p: [m for m in re.finditer(p, t)]
    return {
        "email": [m.span() for m in find(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")],
        "ip": [m.span() for m in find(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)") if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in find(r"[0-9]([\x20-]?[0-9])+") if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
        "phone": [m.span() for m in find(r"\+[0-9][\x20().0-9-]+[0-9]") if 9 <= len(digits(m[0])) <= 15],
    }


def test_base_spans_match_their_definition(spark):
    rng = random.Random(3)
    for _ in range(20_000):
        t = "".join(rng.choices("a.@-+ 01239()%é", k=rng.randint(0, 30)))
        assert pii.base_spans(t) == brute_pii(t), t
    text = "Mail é.x@a.b.co or visa 4111 1111 1111 1111, tel +1 (555) 010-9999, host 10.0.0.1, IBAN DE89 3704 0044 0532 0130 00."
    rows = [(1, text, None, None, None), (2, "4" * 300_000, None, None, None), (3, "1." * 100_000, None, None, None), *edges()]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in pii.find(df).collect()}
    base = ",".join(f"{k}:{a}:{b}" for k, spans in brute_pii(text).items() for a, b in spans)
    r = got[1]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.n_iban) == (1, 1, 1, 1, 1)
    assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and r.spans.startswith(base + ",iban:")
    assert got[10_001].base_sha256 == hashlib.sha256(b"").hexdigest() and got[2].n_card == 0
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean[1] == "Mail é<email> or visa <card>, tel <phone>, host <ip>, IBAN <iban>." and clean[10_001] is None
    assert pii.find(df.limit(0)).collect() == []


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_common_subsequence():
    rng = random.Random(9)
    for _ in range(300):
        a, b = rng.choices(range(6), k=rng.randint(1, 90)), rng.choices(range(6), k=rng.randint(0, 90))
        assert decontaminate.common_subsequence(a, b) == lcs(a, b)


def test_contamination(spark):
    rng = random.Random(8)
    syllables = [a + b for a in "bcdfglmnprst" for b in ("a", "e", "i", "or", "un")]
    items = [(i, invented(rng, syllables, rng.randint(15, 70)), "x") for i in range(40)] + [(90, None, "x"), (91, "", "x")]
    rows, truth = [], set()
    for i in range(300):
        words = invented(rng, syllables, rng.randint(50, 400)).split()
        if i % 6 == 0:
            item = rng.choice(items[:40])
            inner = item[1].upper().split() if i % 12 else [w for w in item[1].split() if rng.random() > 0.1]
            at = rng.randrange(len(words))
            words[at:at] = inner
            truth.add((i, item[0]))
        rows.append((i, " ".join(words), None, None, None))
    df = spark.createDataFrame(rows + edges(), SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string, lang string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_contamination(df, bench).collect()}
    assert got <= truth and len(got) >= 0.9 * len(truth)
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id < 300} == set(range(300)) - {d for d, _ in got}
    assert decontaminate.find_contamination(df, bench.limit(0)).collect() == []
    assert decontaminate.find_contamination(df.limit(0), bench).collect() == []


def test_batches_are_bounded_in_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    rows = spark.range(0, 2_000, 1, 1).selectExpr("CASE WHEN id = 7 THEN repeat('y', 9000000) ELSE repeat('x', 10000) END AS text")
    seen = common.in_batches(rows, sizes, "n long, size long").collect()
    assert sum(r.n for r in seen) == 2_000 and len(seen) >= 6
    assert sorted(r["size"] for r in seen)[-2] < 2 * common.BATCH_BYTES
