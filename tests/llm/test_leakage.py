import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import leakage as L


def brute(text, items):
    def grams(w, n):
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    doc = L.words(text or "")
    out = []
    for i, t in items:
        w = L.words(t or "")
        four = grams(w, min(4, len(w))) if w else set()
        if grams(w, 12) & grams(doc, 12) or (four and 2 * len(four & grams(doc, min(4, len(w)))) >= len(four)):
            out.append(i)
    return sorted(out)


def test_words():
    assert L.words("A\u00adb C\u200bd e\u0301_x 12a ＿ÇA") == ["ab", "cd", "é", "x", "12a", "ça"]
    assert L.words(unicodedata.normalize("NFD", "Málaga")) == ["málaga"]


def test_forms_of_leaks():
    w = [f"w{i}" for i in range(40)]
    items = [(1, " ".join(w)), (2, "a b c"), (3, "x y z q x y z q x y z q"), (4, None), (5, ""), (6, "p q r s")]
    p = L.Patterns(items)
    assert p.leaks("pre " + " ".join(w[5:17]).upper() + " post") == [1] and p.leaks(" ".join(w[5:16])) == []
    assert p.leaks(", ".join(w[:6]) + " zz " + ". ".join(w[10:27])) == brute(", ".join(w[:6]) + " zz " + ". ".join(w[10:27]), items)
    assert p.leaks("a b c") == [2] and p.leaks("a b d c") == [] and p.leaks("x y z q x y") == [3] and p.leaks("p q r s") == [6] and p.leaks("") == []


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**9))
def test_against_brute_force(seed):
    r = random.Random(seed)
    voc = "abcd"[: r.randint(2, 4)]
    text = lambda n: " ".join(r.choice(voc) for _ in range(r.randint(0, n)))
    items = [(i, text(20)) for i in range(r.randint(1, 4))]
    doc = " ".join(x for x in [text(10), r.choice(items)[1], text(10), r.choice(items)[1][: r.randint(0, 30)]])
    assert L.Patterns(items).leaks(doc) == brute(doc, items)


def test_on_spark(spark):
    r = random.Random(5)
    voc = [f"v{i}" for i in range(30)]
    items = [(i, " ".join(r.choice(voc) for _ in range(r.randint(3, 30)))) for i in range(12)] + [(99, None)]
    docs = [(d, " ".join(r.choice(voc) for _ in range(20)) + " " + (items[d % 12][1] or "") + " end", "x") for d in range(30)] + [(50, None, "x"), (51, "", "x"), (3, "v1", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    it = spark.createDataFrame(items, "item_id long, text string")
    want = {(d, i) for d, t, _ in docs for i in brute(t, items)}
    for table_bytes in (L.TABLE_BYTES, 0):
        got = [(r["doc_id"], r["item_id"]) for r in L.find_leaks(df, it, "doc_id", "text", "item_id", "text", table_bytes).collect()]
        assert set(got) == want and len(got) == len(want)
        assert L.find_leaks(df.limit(0), it, "doc_id", "text", "item_id", "text", table_bytes).count() == 0
    assert L.find_leaks(df.limit(0), it, "doc_id", "text", "item_id", "text").count() == 0
    assert L.find_leaks(df, it.limit(0), "doc_id", "text", "item_id", "text").count() == 0


def test_short_items_and_scripts_without_blanks(spark):
    items = [(1, "alpha beta gamma"), (2, "東京で新しい計測器を試した。"), (3, "solo"), (4, "ภาษาไทยไม่มีช่องว่าง"), (5, " ... "), (6, "two words")]
    texts = ["we saw Alpha, beta gamma here", "alpha gamma beta", "昨日、東京で新しい計測器を試したそうだ", "東京は新しい", "SOLO", "soloist", "เขาว่าภาษาไทยไม่มีช่องว่างนะ", "two (words)", "two other words", ""]
    want = {(d, i) for d, t in enumerate(texts) for i in brute(t, items)}
    assert want == {(0, 1), (2, 2), (4, 3), (6, 4), (7, 6)}
    df, it = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), spark.createDataFrame(items, "item_id long, text string")
    for table_bytes in (L.TABLE_BYTES, 0):
        assert {tuple(r) for r in L.find_leaks(df, it, "doc_id", "text", "item_id", "text", table_bytes).collect()} == want
    assert L.words("abc東京x1・カナー") == ["abc", "東", "京", "x1", "カ", "ナ", "ー"]


@pytest.mark.parametrize("seed", range(3))
def test_spread_patterns_agree_with_tables(spark, seed):
    r = random.Random(seed)
    voc = "abcde"
    text = lambda n: " ".join(r.choice(voc) for _ in range(r.randint(0, n)))
    items = [(i, text(40)) for i in range(30)]
    texts = [(d, " ".join([text(20), r.choice(items)[1], text(9)])) for d in range(60)]
    df, it = spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(d, i) for d, t in texts for i in brute(t, items)}
    assert want and {tuple(r) for r in L.find_leaks(df, it, "doc_id", "text", "item_id", "text", 0).collect()} == want
