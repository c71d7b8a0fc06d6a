import random

import xxhash
from pyspark.sql import functions as F

from lodestrata.llm import truncation as T

NOUNS = "gap graph scope ledger packet anchor cursor matrix token branch record module".split()
VERBS = "holds copies sorts keeps drops reads joins folds".split()


def sentence(r):
    return f"The {r.choice(NOUNS)} {r.choice(VERBS)} {r.randint(10, 9999)} rows of every {r.choice(NOUNS)} before the {r.choice(NOUNS)} {r.choice(VERBS)} it."


def body(r, n=None):
    return " ".join(sentence(r) for _ in range(n or r.randint(3, 9)))


def corpus():
    r = random.Random(3)
    rows, cut = [], set()

    def add(text, source, is_cut=False):
        rows.append((len(rows), text, source))
        if is_cut:
            cut.add(len(rows) - 1)

    for _ in range(300):
        add(body(r), "free")
        add(body(r) + "\n\n" + r.choice(["Signed off by all", "More on that later...", "Status: done"]), "free")
    for _ in range(60):
        t = body(r, 12)
        add(t if len(t) <= 400 else t[:400], "limited", len(t) > 400 and t[399] != ".")
        t = body(r, 12)
        add(t[:390] + "…", "marked", t[389] not in ". ")
    for _ in range(20):
        t = body(r)
        add(t[: r.randint(40, 120)].rstrip(". ") + "ab", "free", True)
    long = body(r, 6) + "\n\nSigned off by all\n\n" + body(r, 3)
    add(long, "free")
    add(long[: long.index("all") + 3], "free", True)
    add("def f(x):\n    return [x]\n\n\nV = {\n    1: 2,\n}", "free")
    add("def f(x):\n    return [x]\n\n\nV = {\n    1: 2,", "free", True)
    for t in (None, "", "  \n"):
        add(t, "free")
    add(body(r), None)
    return rows, cut


def test_found_and_rates(spark):
    rows, cut = corpus()
    df = spark.createDataFrame([(*x, "n") for x in rows + [rows[0]] * 50], "doc_id long, text string, source string, bytes string")
    got = T.judge_texts(df, ["doc_id"], "text", "source").collect()
    found = {r["doc_id"] for r in got if r["cut"]}
    marked = {i for i, _, s in rows if s == "marked"}
    assert found - marked == cut - marked
    assert marked & cut <= found
    assert {r["doc_id"] for r in got if r["has_longer"]} >= {max(cut) - 2}
    assert all(r["at_limit"] for r in got if r["doc_id"] in cut and rows[r["doc_id"]][2] == "limited")


def test_strict_prefixes_over_partitions(spark, monkeypatch):
    monkeypatch.setattr(T, "TEXTS_PER_TASK", 3)
    r = random.Random(1)
    texts = sorted({"".join(r.choice("ab") for _ in range(r.randint(1, 7))) for _ in range(60)})
    df = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    got = {x["key"] for x in T.strict_prefixes(df).collect()}
    assert got == {i for i, t in enumerate(texts) if any(u != t and u.startswith(t) for u in texts)}


def test_longer_copies_of_short_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(T, "PREFIX", 4)
    r = random.Random(2)
    texts = ["".join(r.choice("abé") for _ in range(r.randint(1, 40))) for _ in range(30)]
    texts += [t[: r.randint(1, len(t))] + r.choice(["", "…", " [truncated]"]) for t in texts * 3]
    bare = {T.without_mark(t) for t in texts}
    df = spark.createDataFrame([(bytes([i]), t) for i, t in enumerate(texts)], "key binary, text string")
    seen = spark.createDataFrame([(bytes([i]), *T.measure(t)) for i, t in enumerate(texts)], f"key binary, {T.MEASURES}")
    got = {x["bare"] for x in T.with_longer_copy(df, seen).collect()}
    assert got == {xxhash.xxh3_128_digest(b.encode()) for b in bare if b and any(o != b and o.startswith(b) for o in bare)}


def judged(spark, text, closings=(), open_kind=False):
    """(whole, stopped) of one text."""
    m = T.measure(text)
    df = spark.createDataFrame([m], T.MEASURES)
    known = [T.measure(f"x\n{c}")[4] for c in closings]
    closes = F.col("closing").isin(known) if known else F.lit(False)
    return tuple(df.select(T.whole_column(closes, F.lit(open_kind)), T.stopped_column(closes)).first())


def test_endings(spark):
    whole = lambda t, *c: judged(spark, t, c)[0]
    stopped = lambda t: judged(spark, t)[1]
    assert whole("It ends.") and whole('He said "no."') and whole("x y\n-- the group") and whole("a\n(see below)") and whole("a.\nRefs: #12") and whole("so it goes\nGood day", "Good day")
    assert not whole("So it was. It en") and not whole("It goes on…") and not whole("It goes on [truncated]") and not whole("x. a, b and")
    assert not stopped("see `docs.") and not stopped("fn a() {\n    let x = b.") and stopped("a b.") and not stopped("it took 3.") and not stopped("a b…")
    # what is no sentence needs no stop: a title, an item of an open list, an address
    assert whole("Fix race in the cache loader") and whole("To buy:\n- milk\n- bread") and whole("It is done. See https://example.org/a/b")
    assert not whole("Why:\n- It is late.\n- It en") and not whole("It is so.\n## Conse") and not whole("We saw it. Then the rest of it went")
    # an ending like most of its source's has no need of a stop either, a heading has
    assert judged(spark, "One day\nreply: ok then", (), True)[0] and not judged(spark, "One day\n## Then", (), True)[0] and not judged(spark, "One day\nreply: ok…", (), True)[0]


def test_endings_are_held_against_the_sources_own(spark):
    r = random.Random(4)
    rows = [(body(r), "stops") for _ in range(300)] + [("Fix race in the cache loader", "stops"), ("Shopping\n- milk\n- bread", "stops"), (body(r) + " See https://example.org/x", "stops")]
    rows += [(body(r).rstrip("."), "open") for _ in range(40)] + [(body(r)[:-4], "stops")]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "doc_id long, text string, source string")
    assert [x["doc_id"] for x in T.judge_texts(df, ["doc_id"], "text", "source").where("cut").collect()] == [len(rows) - 1]


def test_a_limit_need_not_be_the_greatest_length(spark):
    r = random.Random(6)
    rows = [((body(r, 12) + " " + body(r, 9))[:400] if i % 2 else body(r), "s") for i in range(200)] + [(body(r, 40), "s")]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "doc_id long, text string, source string")
    got = {x["doc_id"] for x in T.judge_texts(df, ["doc_id"], "text", "source").where("at_limit").collect()}
    assert got >= {i for i in range(1, 200, 2)} and 200 not in got


def test_tables_beyond_the_broadcast_limit(spark, monkeypatch):
    rows, cut = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    small = {tuple(r) for r in T.judge_texts(df, ["doc_id"], "text", "source").collect()}
    monkeypatch.setattr(T, "BROADCAST_LIMIT_BYTES", -1)
    assert {tuple(r) for r in T.judge_texts(df, ["doc_id"], "text", "source").collect()} == small and len(small) == len(rows)


def test_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert T.judge_texts(df, ["doc_id"], "text", "source").count() == 0
    df = spark.createDataFrame([(1, None, None), (2, " ", "s")], "doc_id long, text string, source string")
    assert [r["cut"] for r in T.judge_texts(df, ["doc_id"], "text", "source").collect()] == [False, False]


def test_a_common_delimiter_does_not_close_open_code(spark):
    whole = lambda t: judged(spark, t, ["}", ")", "*/", "Good day"])[0]
    assert not whole("fn a() {\n    if b {\n        c();\n    }")
    assert not whole("def f(x):\n    return g(\n        h(\n            x\n        )")
    assert whole("fn a() {\n    if b {\n        c();\n    }\n}") and whole("so it goes\nGood day")
