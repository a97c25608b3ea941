import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from vexel.llm import language_model as lm
from vexel.llm._words import chunks


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def base(rows):
    """The contract's columns but the score."""
    token_lists, held = [], []
    for i, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        token_lists.append([w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in low).split(" ") if w] + ["<end>"])
        held.append(i is not None and zlib.crc32(str(i).encode()) % 5 == 1)
    counts = Counter(t for own, h in zip(token_lists, held, strict=True) if not h for t in own)
    total, kinds = sum(counts.values()), len(counts)
    norm = math.log10(total + 0.5 * (kinds + 1))
    return [(i, h, len(own), sum(t in counts for t in own), total, sum(math.log10(counts[t] + 0.5) - norm for t in own)) for (i, _), own, h in zip(rows, token_lists, held, strict=True)]


def same(got, want):
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=str)
    return len(got) == len(want) and all(a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * abs(b[5]) for a, b in zip(got, sorted(want, key=str), strict=True))


def test_better_than_the_base_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lm.score_documents(docs)
    total = {r.held_out: (r.b, r.s) for r in got.groupBy("held_out").agg(F.sum("base_score").alias("b"), F.sum("score").alias("s")).collect()}
    assert total[False][1] > 0.98 * total[False][0] and total[True][1] > 0.98 * total[True][0]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert same(got.collect(), base(rows))
    assert same(lm.score_documents(docs, vocabulary=500).collect(), base(rows))


def test_the_model_is_one_for_any_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "STRETCH", 2)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, many = ({r.doc_id: r.score for r in lm.score_documents(docs.repartition(n, "text"), shard_tokens=20_000, rounds=2).collect()} for n in (1, 13))
    assert one.keys() == many.keys() and all(abs(one[k] - many[k]) < 1e-5 * abs(one[k]) for k in one)


def test_every_training_token_is_learned(spark, monkeypatch):
    monkeypatch.setattr(lm, "STRETCH", 1)
    learned = []
    monkeypatch.setattr(lm, "trained", lambda *a, run=lm.trained: learned.append(run(*a)) or learned[-1])
    rows = [(k if k % 7 else None, f"a{k} b c " * (k % 40), "en") for k in range(300)]
    got = lm.score_documents(documents(spark, rows), shard_tokens=500, rounds=3).first()
    assert learned[0][1] == got.train_tokens == sum(3 * (k % 40) + 1 for k, (i, _, _) in enumerate(rows) if i is None or zlib.crc32(str(i).encode()) % 5 != 1)


def test_probabilities_sum_to_one():
    texts = [" ".join(f"w{(k * j) % (3 + j)}" for j in range(1, 80)) for k in range(50)]
    import pyarrow as pa

    words = np.concatenate([np.r_[w.hashes, np.full(len(w), lm.END)] for _, w in chunks(pa.array(texts))])
    kinds, counts = np.unique(words, return_counts=True)
    table = (counts >= 3) | (kinds == lm.END)
    v = lm.Vocabulary(kinds[table], counts[table], kinds[table].view(np.int64) % 3, int(counts.sum()), len(kinds))
    learner = lm.Learner(v, lm.start_weights(v))
    docs = []
    for _, w in chunks(pa.array(texts)):
        at = v.look(w.hashes)
        inputs = np.where(at >= 0, v.input[at], v.rare_input).astype(np.uint16)
        docs += [np.r_[inputs[a:b], np.uint16(v.end_input)] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    for _ in range(5):
        learner.stretch(docs)
    h = np.random.default_rng(1).standard_normal((4, lm.STATE)).astype(np.float32)
    classes = lm._softmax(h @ learner.p["c"] + learner.p["cb"]).astype(np.float64)
    total = classes[:, v.end].copy()
    for k, hash_ in enumerate(v.words):
        if hash_ == lm.END:
            continue
        if v.row[v.of[k]] >= 0:
            row = v.row[v.of[k]]
            total += classes[:, v.of[k]] * lm._softmax(h @ learner.p["w"][row] + learner.p["wb"][row])[:, v.slot[k]]
        else:
            total += classes[:, v.of[k]] * 10 ** v.flat[k]
    # words outside the table, and the unseen one
    total += classes[:, v.rare] * ((counts[~table] + 0.5).sum() + 0.5) / 10 ** v.log_mass[v.rare]
    assert np.allclose(total, 1, atol=1e-4)


def test_scores_in_columns_and_gradients(monkeypatch):
    pick = np.random.default_rng(4)
    kinds = np.r_[np.arange(1, 200, dtype=np.uint64), lm.END]
    counts = pick.integers(1, 50, len(kinds))
    v = lm.Vocabulary(kinds, counts, np.arange(len(kinds)) % 2, int(counts.sum()) + 9, len(kinds) + 5)
    p = {k: a + pick.standard_normal(a.shape).astype(np.float32) * 0.1 for k, a in lm.start_weights(v).items()}
    hs, rows = pick.standard_normal((50, lm.STATE)).astype(np.float32), pick.integers(-1, len(v.soft), 50).astype(np.int16)
    inner = lm.Inner(p, hs, rows)
    assert sorted(inner.at) == list(np.flatnonzero(rows >= 0)) and inner.scores.shape == (lm.BAND_WORDS, len(inner.at))
    assert all(np.allclose(inner.scores[:, k], hs[i] @ p["w"][rows[i]] + p["wb"][rows[i]], atol=1e-5) for k, i in enumerate(inner.at))
    docs = [v.input[pick.integers(0, len(kinds) - 1, n)].astype(np.uint16) for n in (6, 0, 7)]  # 16 tokens, one window of one lane
    found = {}
    monkeypatch.setattr(lm.Learner, "_update", lambda self, g, fill: found.update(g))
    lm.Learner(v, p).stretch([np.r_[d, np.uint16(v.end_input)] for d in docs])
    loss = lambda q: -lm.document_scores(v, q, docs).sum() * np.log(10) / 16
    for name, g in found.items():
        for at in np.argsort(-abs(g).ravel())[:4]:
            more, less = ({k: a.copy() for k, a in p.items()} for _ in range(2))
            more[name].ravel()[at] += 0.01
            less[name].ravel()[at] -= 0.01
            assert abs((loss(more) - loss(less)) / 0.02 - g.ravel()[at]) < 2e-3 * max(1, abs(g.ravel()[at]))


def test_nulls_empty_and_long_texts_repeated_rows_and_no_rows(spark):
    rows = [(None, "a b A", None), (None, None, "en"), (1, "", "en"), (2, "a  b\tc", "de"), (2, "a  b\tc", "de"), (3, "word " * 100_000, "en"), (6, "unseen", "en"), (11, "b " * 3, None)]
    docs = documents(spark, rows).selectExpr("*", "1 as row", "2 as tokens", "'x' as held_out")
    got = lm.score_documents(docs).collect()
    assert same(got, base([r[:2] for r in rows])) and all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert lm.score_documents(docs.limit(0)).count() == 0
    held = documents(spark, [(k, "x y", "en") for k in range(200) if zlib.crc32(str(k).encode()) % 5 == 1])
    assert all(r.train_tokens == 0 and r.n_known == 0 and np.isfinite(r.score) for r in lm.score_documents(held).collect())
