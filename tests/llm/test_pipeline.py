import hashlib
import math
import random

import pytest

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in low).split(" ") if w]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    pick = random.Random(11)
    text = lambda n: " ".join(f"{pick.choice('abcdefgh')}{pick.randrange(400)}" for _ in range(n))
    rows, labels = [], []

    def add(doc_id, body, good=None):
        rows.append((doc_id, body, pick.choice(["en", "de", None]), pick.choice(["s1", "s1", "s1", "s2", None]), None if body is None else len(body)))
        if good is not None and doc_id is not None:
            labels.append((doc_id, int(good), 0))

    items = [(k, text(14)) for k in range(5)] + [(9, "tiny item"), (None, None)]
    for k in range(90):
        add(k, text(pick.randrange(30, 90)), True if k % 2 else None)
    for k in range(40):
        add(200 + k, " ".join("#!? @@## SPAM | $$$ ** spam spam" for _ in range(pick.randrange(3, 9))) + f" {k}", False if k % 2 else None)
    for k in range(30):  # near and equal copies
        base = rows[k][1].split(" ")
        for n in range(1 + k % 4):
            own = list(base)
            if n:
                own[n * 3] = "changed"
            add(300 + k * 5 + n, " ".join(own))
    for k in range(10):
        add(600 + k, f"{text(20)} {items[k % 6][1].upper()} {text(20)}")
    add(7, rows[3][1]), add(7, text(40)), add(None, rows[4][1]), add(None, text(50)), add(800, None), add(801, ""), add(3, rows[3][1])
    d = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    """What goes into and comes out of each stage."""
    out, docs = {}, spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
        path = str(tmp_path_factory.mktemp(f"stage{k}") / "out")
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = before, [tuple(r) for r in docs.collect()], docs.columns
    return out


def test_the_stages_and_their_columns(stages, spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing sources", "sharding"]
    assert all(columns == ["doc_id", "text", "lang", "source", "n_chars"] for _, _, columns in list(stages.values())[:-1])
    run = sorted((tuple(r) for r in corpus_pipeline.run(spark, folder).collect()), key=str)
    assert run == sorted(stages["sharding"][1], key=str)


def test_quality_rejects_what_the_posteriors_say(stages, spark, folder):
    from vexel.llm import quality

    before, after, _ = stages["quality classifier"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    scored = quality.classify(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()
    m = {}
    hosts, paths = {}, {}
    for r in scored:
        for held, key in ((hosts, r.source), (paths, (r.source, r.lang))):
            k, n = held.get(key, (0.0, 0))
            held[key] = k + r.doc_score, n + 1
    base = sum(r.doc_score for r in scored) / len(scored)

    def strength(groups, mean):
        n = sum(n for _, n in groups.values())
        room = n - sum(n * n for _, n in groups.values()) / n
        between = (sum(n * (k / n - mean(key)) ** 2 for key, (k, n) in groups.items()) - (len(groups) - 1) * base * (1 - base)) / room
        return min(max(base * (1 - base) / between - 1 if between > 0 else 1e4, 1.0), 1e4)

    m["host"], m["path"] = strength(hosts, lambda _: base), strength(paths, lambda key: hosts[key[0]][0] / hosts[key[0]][1])
    kept = []
    for r in scored:
        k, n = hosts[r.source]
        host = (k - r.doc_score + m["host"] * base) / (n - 1 + m["host"])
        k, n = paths[r.source, r.lang]
        path = (k - r.doc_score + m["path"] * host) / (n - 1 + m["path"])
        z = math.log(r.doc_score / (1 - r.doc_score)) + math.log(path / (1 - path)) - math.log(base / (1 - base))
        assert abs(r.quality - 1 / (1 + math.exp(-z))) < 1e-6
        if z >= 0:
            kept.append((r.doc_id, r.text, r.lang, r.source, r.n_chars))
    assert sorted(kept, key=str) == sorted(after, key=str)
    ids = [r[0] for r in after]
    assert sum(200 <= (i or 0) < 240 for i in ids) <= 2 and sum(0 <= (i if i is not None else -1) < 90 for i in ids) >= 88


def test_one_of_each_group_of_near_copies_stays(stages):
    before, after, _ = stages["n-gram Jaccard join"]
    sets = []
    for _, text, *_ in before:
        w = words(text)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    own = list(range(len(before)))

    def root(k):
        while own[k] != k:
            k = own[k]
        return k

    for a in range(len(before)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                own[root(a)] = root(b)
    best = {}
    for k, r in enumerate(before):
        best.setdefault(root(k), []).append((r[0] is None, r[0] or 0, str(r)))
    assert sorted(min(v)[:2] for v in best.values()) == sorted((r[0] is None, r[0] or 0) for r in after)
    assert len(after) == len(best) and {str(r) for r in after} <= {str(r) for r in before} and any(r[0] == 7 for r in after)


def test_contaminated_documents_go(stages, spark, folder):
    before, after, _ = stages["benchmark decontamination"]
    tokens = lambda t: words("".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in t or ""))
    windows = set()
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        w = tokens(r.text)
        windows |= {tuple(w[i : i + min(10, len(w))]) for i in range(max(1, len(w) - 9)) if w}
    sizes = {len(w) for w in windows}
    clean = [r for r in before if not any(tuple(w[i : i + n]) in windows for w in (tokens(r[1]),) for n in sizes for i in range(len(w)))]
    assert sorted(clean, key=str) == sorted(after, key=str) and len(clean) < len(before)


def test_sources_are_mixed_to_their_targets(stages):
    before, after, _ = stages["mixing sources"]
    size = {}
    for r in before:
        size[r[3]] = size.get(r[3], 0) + len(words(r[1]))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(names)}
    target, open_ = {}, set(names)
    budget = 1.5 * sum(size.values())
    while open_:
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= 2 * size[s]}
        target |= {s: 2 * size[s] for s in full}
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        open_ -= full
    key = lambda r: int(hashlib.md5(("mix-1:" + (str(r[0]) if r[0] is not None else "null" + hashlib.md5((r[1] or "").encode()).hexdigest())).encode()).hexdigest()[:15], 16)
    want = []
    for s in names:
        rows = sorted((r for r in before if r[3] == s), key=lambda r: (key(r), r[0] or 0, len(words(r[1]))))
        total = int(target[s])
        epochs, rest = (total // size[s], total % size[s]) if size[s] else (1, 0)
        cut = None
        for r in rows:
            n = len(words(r[1]))
            take = max(0, min(n, rest))
            rest -= n
            if take > 0 and 2 * take >= n:
                cut = key(r)
        want += [r for r in rows for _ in range(epochs + (cut is not None and key(r) <= cut))]
    assert sorted(want, key=str) == sorted(after, key=str)


def test_shards_hold_all_rows_and_their_groups(stages):
    before, after, columns = stages["sharding"]
    assert columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "shard", "slot"] and sorted(before, key=str) == sorted((r[:5] for r in after), key=str)
    by, texts = {}, {}
    for r in after:
        assert r[5] == (len(r[1].encode()) if r[1] else 0) + 1
        by.setdefault(r[6], []).append(r)
        texts.setdefault(r[1], set()).add(r[6])
    loads = [sum(r[5] for r in v) for v in by.values()]
    assert len(by) == 16 and all(len(v) == 1 for v in texts.values()) and all(sorted(r[7] for r in v) == list(range(len(v))) for v in by.values())
    assert max(loads) <= 1.3 * sum(loads) / 16


def test_an_empty_table_passes_all_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.count() == 0


def test_columns_that_clash_come_through(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "1 as _row", "2 as component_id", "3 as hit_from", "4 as _key", "5 as base", "6 as _component")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, folder)
        assert got.columns == docs.columns and {(r._row, r.component_id, r.hit_from, r._key, r.base, r._component) for r in got.collect()} == {(1, 2, 3, 4, 5, 6)}
    assert corpus_pipeline.sharding(spark, docs, folder).columns == docs.columns + ["size", "shard", "slot"]
