import pytest
from pyspark.sql import functions as F

from stylomill.functions import text as X
from stylomill.operators import clean

TEXTS = ["", "   ", None, "a b", "a\u001cb", "a　b", "x y z", "привет abc", "naïve café", "123 !!", "a\nb\tc", "ok 😀!", "x​y", 'Hi, "x" — ok! 😀']


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t STRING").select(column(F.col("t")).alias("r")).first()["r"]


@pytest.mark.parametrize("text", TEXTS)
def test_words_as_python_splits(spark, text):
    want = (text or "").split()
    assert one(spark, text, X.n_words) == len(want)
    assert one(spark, text, X.words) == want
    assert one(spark, text, X.squash) == " ".join(want)


def test_strip_and_marks(spark):
    assert [one(spark, t, X.strip_symbols) for t in ("a\nb\tc", "ok 😀!", "x​y", None)] == ["abc", "ok !", "xy", None]
    assert one(spark, 'Hi, "x" — ok! 😀', X.marks) == [",", "—", "!", "😀"]
    assert one(spark, None, X.marks) == []
    assert one(spark, "a! b! c?", lambda c: X.ngrams(X.marks(c), 2)) == ["!", "!", "?", "!|!", "!|?"]
    assert one(spark, "", lambda c: X.ngrams(X.marks(c), 3)) == []


def test_english(spark, frame):
    rows = [(i, "a", "Tweet", t) for i, t in enumerate(["привет abc", "naïve café", "123 !!", "", None, "plain words", "KKİ ok"])]
    assert sorted(r["id"] for r in clean.english_only(frame(rows)).collect()) == [5, 6]


def test_mask(spark, frame):
    t = "mail a.b@c.org see https://t.co/x by @Bob and @bob and @Al"
    assert one(spark, t, X.mask_handles) == "mail <EMAIL> see <URL> by USER_1 and USER_1 and USER_2"
    assert one(spark, "@abcdefghijklmnopq", X.mask_handles) == "USER_1pq"
    assert one(spark, "no mention @ all", X.mask_handles) == "no mention @ all"
    got = frame([(1, "a", "Article", t), (2, "a", "tWeet", t), (3, "a", None, t), (4, "a", "Tweet", None)]).select("id", X.mask_tweet("text", "genre").alias("m")).collect()
    assert {r["id"]: r["m"] == t for r in got if r["id"] < 4} == {1: True, 2: False, 3: True}
    assert next(r["m"] for r in got if r["id"] == 4) is None


def test_bins_and_hashes(spark):
    rows = spark.createDataFrame([(199,), (200,), (399,), (400,), (799,), (800,), (None,)], "n INT").select(X.length_bin(F.col("n")).alias("b"))
    assert [r["b"] for r in rows.collect()] == ["0-199", "200-399", "200-399", "400-799", "400-799", "800+", "0-199"]
    assert spark.range(1).select(X.hash_index(F.lit("a|1"), 1 << 40).alias("h")).first()["h"] == 1184863232
    assert spark.range(1).select(X.hash_index(F.lit("a"), 0).alias("h")).first()["h"] == 0


def test_name_key(spark):
    assert [one(spark, t, X.name_key) for t in ("  Milo  A\tThorn ", "", "   ", None)] == ["milo a thorn", None, None, None]


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0])], "a ARRAY<FLOAT>, b ARRAY<FLOAT>")
    assert [r[0] for r in rows.select(X.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, None, None]


def test_cleaning(spark, frame):
    nineteen, twenty = " ".join("w" * 19), " ".join("w" * 20)
    rows = [(1, "a", "Article", nineteen), (2, "a", "Article", twenty), (3, "a", "article", "x y z"), (4, None, "Tweet", "x y z"), (5, "b", None, None), (6, "a", "Article", None)]
    assert sorted(r["id"] for r in clean.drop_short(frame(rows)).collect()) == [2, 3, 4, 5]
    assert sorted(r["id"] for r in clean.exclude_author(frame(rows), "a").collect()) == [4, 5]
    assert sorted(r["id"] for r in clean.texts_of_length(frame(rows), 0).collect()) == [5, 6]
    d = frame([(1, "a", "T", "same"), (2, "a", "T", "same"), (3, "b", "T", "same"), (4, "a", "T", None), (5, "a", "T", None)])
    assert sorted((r["id"], r["copies"]) for r in clean.dedup_author_text(d).collect()) == [(1, 2), (3, 1), (4, 2)]
    assert sorted((r["n_rows"], r["n_authors"], r["first_id"]) for r in clean.duplicate_texts(d).collect()) == [(2, 1, 4), (3, 2, 1)]
    full = clean.clean_corpus(frame([(1, "a", "Tweet", "hello @bob 😀 fine"), (2, "a", "Tweet", "привет"), (3, "a", "Article", None)])).collect()
    assert [(r["id"], r["text"], r["pe_seq"]) for r in full] == [(1, "hello USER_1  fine", "😀")]
    counts = clean.with_mark_counts(frame([(1, "a", "T", "a! b! c?"), (2, "a", "T", None)]), 2)
    assert {r["id"]: r["pe_counts"] for r in counts.collect()} == {1: {"!": 2, "?": 1, "!|!": 1, "!|?": 1}, 2: None}
