import numpy as np
import pyarrow as pa

from vexel.llm import ngram_join


def brute(rows):
    sets = {}
    for doc, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = low.replace("\t", " ").replace("\n", " ").split(" ")
        w = [x for x in w if x]
        sets[doc] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    own, links = {d: d for d in sets}, dict.fromkeys(sets, 0)

    def root(d):
        while own[d] != d:
            d = own[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                own[y] = x
                links[a] += 1
                links[b] += 1
    return {(d, len(sets[d]), root(d), links[d]) for d in sets}


def test_components_against_brute_force(spark):
    random = np.random.default_rng(5)
    base = [f"w{i}" for i in random.integers(0, 10_000, 120)]
    rows = [(0, None), (1, ""), (2, "one two"), (3, "One  two"), (4, "Ä b c d e f g")]
    for i in range(5, 90):
        w = list(base)
        for at in random.integers(0, 120, int(random.integers(0, 8))):
            w[at] = f"x{random.integers(0, 30)}"
        rows.append((i, " ".join(w[: int(random.integers(80, 121))])))
    for i in range(90, 150):  # one common passage in unlike texts
        rows.append((i, " ".join([f"y{k}" for k in random.integers(0, 10_000, 60)] + base[:40])))
    got = ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "2 as root"))
    assert {tuple(r) for r in got.collect()} == brute(rows)


def test_sets_of_short_texts():
    sets = list(ngram_join.shingle_sets(pa.array(["a b c", "A B  C", None, " ", "a b c d e f"]), 5))
    assert [len(s) for s in sets] == [1, 1, 0, 0, 2] and (sets[0] == sets[1]).all()


def test_empty_table_and_missing_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.similar_documents(docs).collect()), key=str) == [(3, 2, 3, 1), (3, 2, 3, 1), (None, 2, None, 0)]
    assert ngram_join.similar_documents(docs.limit(0)).count() == 0


def test_large_groups_whose_members_miss_the_anchor(spark, monkeypatch):
    # blocks of a few sets, two groups of near copies about the bound, copies of some of them, other lengths of text
    monkeypatch.setattr(ngram_join, "OPEN_SHINGLES", 500)
    monkeypatch.setattr(ngram_join, "HUB_ROWS", 4)
    random = np.random.default_rng(8)
    rows = []
    for g in range(2):
        base = [f"g{g}w{i}" for i in random.integers(0, 1000, 90)]
        for _ in range(110):
            w = list(base)
            for at in random.integers(0, 90, int(random.integers(1, 5))):
                w[at] = f"x{random.integers(0, 10_000)}"
            at = int(random.integers(0, 20))
            rows.append((len(rows), " ".join(w[at : at + int(random.integers(60, 91))])))
    rows += [(len(rows) + k, rows[7 * k][1]) for k in range(20)]
    rows += [(len(rows) + k, f"{rows[k][1]} {' '.join(f'y{k}z{j}' for j in range(k))}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert len({r[2] for r in want}) > 10 and max(r[3] for r in want) > 10
    assert {tuple(r) for r in ngram_join.similar_documents(docs).collect()} == want


def test_documents_under_one_id(spark):
    text, other = "a b c d e f g h", "i j k l m n o p"
    docs = spark.createDataFrame([(1, text), (7, text), (7, other), (7, text), (9, None)], "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.similar_documents(docs).collect()))
    assert got == [(1, 4, 1, 2), (7, 4, 1, 2), (7, 4, 1, 2), (7, 4, 7, 0), (9, 0, 9, 0)]
