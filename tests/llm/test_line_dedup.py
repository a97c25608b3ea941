import time

from vexel.llm.line_dedup import dedup_lines, repeated_lines


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows):
    lines = []
    for doc, text in rows:
        if text is not None:
            for no, line in enumerate(text.split("\n")):
                words = [w for w in line.replace("\t", " ").split(" ") if w]
                if words:
                    lines.append(((doc is None, doc or 0, no), doc, no, words))
    out = set()
    for at, doc, no, w in lines:
        equal = [x for x in lines if x[3] == w and x[0] < at]
        if equal:
            out.add((doc, no, "equal", min(equal)[1], min(equal)[2]))
            continue
        close = [x for x in lines if x[0] < at and len(w) >= 4 and len(x[3]) >= 4 and near(w, x[3])]
        if close:
            first = min(close, key=lambda x: x[0])
            out.add((doc, no, "near", first[1], first[2]))
    return out


def test_against_brute_force(spark):
    base = "a b c d e f g h i j k l".split()
    put = lambda *w: " ".join(w)
    rows = [
        (1, put(*base) + "\n\nshort line"),
        (2, put(*base[:3], "X", *base[4:]) + "\nshort line\nshort line"),
        (3, put(*base[:9], *base[10:])),
        (4, put("new", *base)),
        (5, put(*base, "end") + "\n" + put(*base)),
        (6, put(*base[:2], "X", "Y", *base[4:])),
        (6, put(*base[:2], "X", "Y", *base[4:])),
        (7, None),
        (8, ""),
        (None, put(*base)),
        (9, put(*(f"w{i}" for i in range(3000))) + "\n" + put(*(f"w{i}" if i != 2900 else "no" for i in range(3000)))),
    ]
    got = repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {tuple(r) for r in got.collect()} == brute(rows)


def test_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60")
    got = {tuple(r) for r in repeated_lines(docs).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_texts_without_repeats_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b\nc", "x", 1), (2, "a b\nd", "y", 2), (3, None, "z", 3)], "doc_id long, text string, line string, at int")
    assert [tuple(r) for r in dedup_lines(docs).orderBy("doc_id").collect()] == [(1, "a b\nc", "x", 1), (2, "d", "y", 2), (3, None, "z", 3)]
    assert dedup_lines(docs.limit(0)).count() == 0


def test_near_lines_without_an_id_and_under_one(spark):
    x, z, near_x = "a b c d e f g h i j", "k l m n o p q r s t", "a b c d X f g h i j"
    report = lambda rows: [tuple(r) for r in repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert report([(None, x), (None, z), (5, near_x)]) == [(None, 0, "near", 5, 0)]
    assert report([(1, x), (1, z), (5, near_x)]) == [(5, 0, "near", 1, 0)]
    assert report([(1, x), (1, near_x), (1, x)]) == [(1, 0, "near", 1, 0)]
    # every one of the three like lines but the earliest
    got = report([(None, f"{x}\nfirst text"), (None, f"{x}\nsecond text"), (None, f"{near_x}\nthird text"), (5, None)])
    assert len(got) == 2 and all((r[0], r[1], r[3], r[4]) == (None, 0, None, 0) for r in got) and "near" in {r[2] for r in got}


def test_long_lines_take_linear_time(spark):
    words = [f"w{i}" for i in range(200_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:150_000], "other", *words[150_001:]])), (3, " ".join(words[:77] + words[78:]))]
    began = time.time()
    got = {tuple(r) for r in repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(2, 0, "near", 1, 0), (3, 0, "near", 1, 0)} and time.time() - began < 90


def test_places_keep_ids_and_lines(spark):
    from pyspark.sql import functions as F

    from vexel.llm import line_dedup as d

    ids = [0, -1, 7, (1 << 63) - 1, -(1 << 63), None]
    rows = [(i, "\n" * n) for i in ids for n in (0, 3)]
    lines = d._lines(spark.createDataFrame(rows, "doc_id long, text string"), "text", "doc_id")
    got = [tuple(r) for r in lines.orderBy("at").select(d._doc_of(F.col("at")), d._line_of(F.col("at"))).collect()]
    assert [x for x in got if x[0] is not None] == sorted((i, n) for i in ids if i is not None for n in (0, 0, 1, 2, 3)) and sorted(n for i, n in got if i is None) == [0, 0, 1, 2, 3] and got[-1][0] is None
