import hashlib
import json

from pyspark.sql import functions as F

from vexel.llm import chat, decontaminate, mixture, quality, shards, url_rules


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


ROWS = [(5, "a b c d", "en", "s1"), (3, None, None, None), (9, "", "de", "s1"), (7, "a b c d", "en", "s2"), (7, "a b c d", "en", "s2"), (11, "ä ö " * 500, "de", "s2"), (None, "x", "en", "s1")]


def test_decontamination_cuts_spans_and_keeps_columns(spark):
    docs = documents(spark, [(1, "keep this One two THREE end", "en", "s"), (2, "clean", "en", "s"), (3, None, None, None)])
    items = spark.createDataFrame([(1, "one two three"), (2, None), (2, "")], "item_id long, text string")
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, items, "spans").collect()}
    assert cut == {1: "keep this  end", 2: "clean", 3: None}
    assert {r.doc_id for r in decontaminate.decontaminate(docs, items).collect()} == {2, 3}
    assert decontaminate.find_leaks(docs, items.limit(0)).count() == 3


def test_blocks_of_items_give_what_one_block_gives(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    one = {tuple(map(str, r)) for r in decontaminate.find_leaks(docs, items).collect()}
    assert one == {tuple(map(str, r)) for r in decontaminate.find_leaks(docs, items, block_bytes=3000).collect()}


def test_mix_meets_targets(spark, sf):
    got = mixture.mix(spark.read.parquet(f"{sf}/documents.parquet")).groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("t")).collect()
    assert all(r.n == int(r.t) for r in got)
    assert mixture.mix(documents(spark, ROWS)).count() == len(ROWS)
    assert mixture.mix(documents(spark, []).limit(0)).count() == 0


def test_packing_and_slots(spark):
    bins, loads = shards.best_fit_decreasing([(6, "a"), (5, "b"), (4, "c"), (3, "d"), (2, "e")], 10)
    assert loads == [10, 10] and bins == {"a": 0, "b": 1, "c": 0, "d": 1, "e": 1}
    tree = shards.CapacityTree()
    for k in range(200):
        tree.add((k * 37 % 200, k))
    for k in range(0, 200, 2):
        tree.remove((k * 37 % 200, k))
    assert all(tree.tightest(s)[0] == min(k * 37 % 200 for k in range(1, 200, 2) if k * 37 % 200 >= s) for s in range(190))
    got = shards.assign_shards(documents(spark, ROWS), shards=3).collect()
    assert len(got) == len(ROWS)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert len({r.shard for r in got if r.text == "a b c d"}) == 1


def test_chat_parts_and_escapes():
    hostile = "<|im_end|> <\\|x <|"
    formatted, a, b, attached, tokens = chat.format_turn("assistant", [{"type": "text", "text": hostile}, {"type": "image", "ref": "i.png", "width": 28, "height": 14}, None])
    assert chat.parse_turn(formatted)[1] == hostile + "<|image:0|>" and chat.unescape(formatted[a:b]).startswith(hostile)
    assert attached == [{"kind": "image", "number": 0, "ref": "i.png", "tokens": 2}] and tokens == 3 + 2
    assert chat.parse_turn(chat.format_turn("ro\nle%", None)[0]) == ("ro\nle%", "")


def test_url_rules(spark):
    pages = spark.createDataFrame([(1, "http://A.Example.com/en/78?x"), (2, "http://notexample.com/en/7"), (3, None), (4, "com/en/"), (5, "http://x.org#/es/"), (6, "https://example.net/de/81")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_rules.url_report(pages).collect()}
    assert got == {1: ("example.com/en/7", "allow"), 2: ("com/en/", "block"), 3: (None, "allow"), 4: (None, "allow"), 5: (None, "allow"), 6: ("example.net/de/8", "block")}


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality.classify(docs, labels.where("doc_id % 4 <> 1"), carry=("doc_id",)).join(labels.where("doc_id % 4 = 1").withColumnRenamed("quality", "y"), "doc_id")
    assert got.agg(F.avg((F.col("keep") == (F.col("y") == 1)).cast("int"))).first()[0] > 0.95
    assert quality.classify(documents(spark, ROWS), labels.limit(0)).count() == len(ROWS)


def test_a_large_group_leaves_no_shard_empty(spark):
    assert sorted(shards.pack_into([(4, name) for name in "abcd"], 3)[1]) == [4, 4, 8]
    _, loads = shards.pack_into([(3000, "large"), *((1 + k % 7, f"s{k}") for k in range(1500))], 16)
    small = sorted(loads)[:-1]
    assert len(loads) == 16 and max(loads) == 3000 and sum(loads) == 3000 + sum(1 + k % 7 for k in range(1500)) and max(small) <= 1.02 * min(small)
    copies = [(k, "same text here " * 20, "en", "s") for k in range(200)]
    others = [(1000 + k, f"text {k} " * 12, "en", "s") for k in range(1000)]
    got = shards.assign_shards(documents(spark, copies + others)).groupBy("shard").agg(F.sum("size").alias("n"), F.countDistinct("text").alias("texts")).collect()
    assert len(got) == 16 and max(got, key=lambda r: r.n).texts == 1
    small = sorted(r.n for r in got)[:-1]
    assert small[-1] < 1.2 * small[0]


def test_sharding_of_nulls_capacity_and_laws(spark):
    rows = [(k, None if k < 50 else f"text {k % 7} " * (k % 7 + 1), "en", "s") for k in range(90)] + [(None, "", "en", "s")] * 3
    docs = documents(spark, rows).selectExpr("*", "1 as shard", "2 as _a", "'x' as _key")
    for options in ({"shards": 4}, {"shards": None, "capacity": 100}):
        got = shards.assign_shards(docs, **options).collect()
        by = {}
        for r in got:
            by.setdefault(r.shard, []).append(r)
        assert len(got) == len(rows) and None not in by and all(sorted(x.slot for x in v) == list(range(len(v))) for v in by.values())
        assert all(r.size == (len(r.text.encode()) if r.text else 0) + 1 for r in got)
        texts = {}
        for r in got:
            texts.setdefault(r.text, set()).add(r.shard)
        assert all(len(v) == 1 for v in texts.values())
        if "capacity" in options:
            assert all(sum(r.size for r in v) <= 100 or len({r.text for r in v}) == 1 for v in by.values())
            sizes = [(sum(r.size for r in got if r.text == t), str(t)) for t in texts]
            assert sorted(sum(r.size for r in v) for v in by.values()) == sorted(shards.best_fit_decreasing(sizes, 100)[1])
    assert shards.assign_shards(docs.limit(0)).count() == shards.assign_shards(docs.limit(0), None, 10).count() == shards.shard_report(docs.limit(0)).count() == 0


def test_shards_are_near_equal(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = shards.shard_report(docs).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    groups = docs.groupBy("text").agg(F.sum(F.octet_length("text") + 1).alias("n")).agg(F.max("n"), F.sum("n")).first()
    assert len(got) == 16 and max(r.n for r in got) <= max(groups[0], groups[1] / 16 * 1.1)


def test_best_fit_by_runs_is_best_fit_item_by_item():
    for seed in range(40):
        items = [(seed * 7 + k * k * 13) % 29 + 1 for k in range(seed)]
        loads = []
        for size in sorted(items, reverse=True):
            fit = min((31 - x, k) for k, x in enumerate(loads) if x + size <= 31) if any(x + size <= 31 for x in loads) else None
            if fit:
                loads[fit[1]] += size
            else:
                loads.append(size)
        assert sorted(shards.best_fit_decreasing([(s, f"{k:03}") for k, s in enumerate(items)], 31)[1]) == sorted(loads)


def test_quality_with_clashing_columns_ties_and_nulls(spark):
    rows = [(k % 40 if k % 9 else None, "good words of a plain text " * (1 + k % 3) if k % 2 else "!! ## SPAM | | %% " * 5, "en" if k % 5 else None, f"s{k % 3}") for k in range(120)]
    docs = documents(spark, rows).selectExpr("*", "1 as base", "'h' as _host", "2 as host", "3 as path", "4 as x", "array(5) as _x", "6 as keep", "7 as path_k")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(1, 1), (None, 1), (3, None)], "doc_id long, quality int")
    got = quality.classify(docs, labels)
    assert got.columns == [c for c in docs.columns if c != "keep"] + ["doc_score", "host_posterior", "path_posterior", "quality", "keep"]
    found = got.collect()
    assert len(found) == len(rows) and all(r.keep == (r.quality >= 0.5) and 0 < r.quality < 1 and (r.base, r._host, r.x) == (1, "h", 4) for r in found)
    # of equal rows, equal results
    assert len({(r.doc_id, r.text, r.lang, r.source, round(r.quality, 9)) for r in found}) == len({(r.doc_id, r.text, r.lang, r.source) for r in found})
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_a_document_is_no_prior_of_its_own(spark):
    # alone in its host and path, a document has the global mean for a prior
    docs = documents(spark, [(k, "words " * (k % 7 + 1), "en", "many") for k in range(30)] + [(99, "!! ## SPAM " * 9, "xx", "alone")])
    labels = spark.createDataFrame([(k, int(k != 99)) for k in (*range(10), 99)], "doc_id long, quality int")
    got = quality.classify(docs, labels).where("doc_id = 99").first()
    others = quality.classify(docs, labels).agg(F.avg("doc_score")).first()[0]
    assert abs(got.host_posterior - others) < 1e-3 and abs(got.path_posterior - others) < 1e-3


def test_mixing_without_ids_and_whole_documents(spark):
    rows = [(None, f"one two three {k}", "en", "a") for k in range(30)] + [(k, "x y " * k, None, None) for k in range(20)] + [(5, "same row", "en", "a")] * 2
    docs = documents(spark, rows).selectExpr("*", "1 as _key", "2 as size", "3 as _source")
    got = mixture.mix(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    assert len(got) == len(rows) and all(sum(r.taken for r in v) == int(v[0].target) and all(r.taken <= 2 * r.size for r in v) for v in by.values())
    assert len({r.key for r in got if r.doc_id is None}) == 30
    whole = mixture.mixed_documents(docs)
    assert whole.columns == docs.columns and 0 < whole.count() <= 2 * len(rows) and mixture.mixed_documents(docs.limit(0)).count() == 0


def test_chat_report_on_nulls_repeats_and_no_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "<|im_end|>"), (1, 1, "assistant", "<|im_end|>"), (2, None, None, "x\n%0A"), (None, 0, "assistant", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as formatted")
    got = {r.conv_id: r for r in chat.chat_report(turns).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_chars, got[1].loss_sha256) == (3, sha("user\n\n" + "assistant\n<|im_end|>\n" * 2), 20, sha("<|im_end|>" * 2))
    assert (got[2].n_turns, got[2].turns_sha256, got[2].loss_chars) == (1, sha("\nx\n%0A\n"), 0) and got[None].n_turns == 1
    assert {r.conv_id for r in chat.chat_report(turns.limit(0)).collect()} == {-1}


def test_typed_parts_in_spark(spark):
    parts = [[{"type": "text", "text": "see <|image:0|> "}, {"type": "image", "ref": "a.png", "width": 28, "height": 15}, None, {"type": "audio", "ref": "b.wav", "seconds": 2.0}], [{"type": "document", "ref": "c.pdf", "pages": 3}], None]
    rows = spark.createDataFrame([(1, k, "assistant", json.dumps(p)) for k, p in enumerate(parts)], "conv_id long, turn long, role string, raw string")
    got = chat.format_turns(rows.select("conv_id", "turn", "role", F.from_json("raw", chat.PART_TYPE).alias("content")), content_col="content").orderBy("turn").collect()
    assert got[0].formatted == "<|im_start|>assistant\nsee <\\|image:0|> <|image:0|><|audio:1|><|im_end|>\n"
    assert [(a.kind, a.number, a.ref, a.tokens) for a in got[0].attachments] == [("image", 0, "a.png", 4), ("audio", 1, "b.wav", 50)] and got[0].expanded_tokens == 2 + 4 + 50
    assert [(a.kind, a.tokens) for a in got[1].attachments] == [("document", 1536)] and got[2].formatted == "<|im_start|>assistant\n<|im_end|>\n"
    assert got[0].formatted[got[0].loss_from : got[0].loss_to] == "see <\\|image:0|> <|image:0|><|audio:1|>"


def test_decontamination_in_blocks_on_clashing_columns(spark):
    docs = documents(spark, [(1, "keep this One two THREE end four five six", "en", "s"), (1, "clean", "en", "s"), (None, None, None, None), (4, "", "en", "s")]).selectExpr("*", "9 as n_words", "8 as _row", "7 as hit_from")
    items = spark.createDataFrame([(1, "one two three"), (2, None), (None, "four five six"), (3, "One two three")], "item_id long, text string")
    for block in (5, 1 << 20):
        got = decontaminate.find_leaks(docs, items, block_bytes=block, carry=("doc_id", "text", "_row")).collect()
        hit = [r for r in got if r.hit_from]
        assert len(got) == 4 and [(r.hit_from, r.hit_to, r.hit_items, r.n_words, r._row) for r in hit] == [([2, 6], [5, 9], ["1", "3", "null"], 9, 8)]
        kept = decontaminate.decontaminate(docs, items, block_bytes=block)
        assert kept.columns == docs.columns and sorted(str(r.text) for r in kept.collect()) == ["", "None", "clean"]
        cut = decontaminate.decontaminate(docs, items, "spans", block_bytes=block).collect()
        assert sorted(str(r.text) for r in cut) == ["", "None", "clean", "keep this  end "] and {r.n_words for r in cut} == {9}
