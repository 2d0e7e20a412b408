from pyspark.sql import functions as F

from corpuscope.functions import language, text as T
from corpuscope.operators.signals import sentences_of, words_of

TEXTS = ["Don't stop. It costs 3.50, see v1.2!", "J. R. R. Tolkien wrote. Dr. Who (etc.) came. \"Yes.\" she said.", "", " \n\t", "½ cup x² naïve é a_b c1d\nline two\r\nthree four\x1cfive", "Mr. Smith... is here! Ok? Fine", "one\n\n two \n \nthree"]


def test_words_and_sentences_equal_python(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").select("i", T.words(F.col("t")).alias("w"), T.sentences(F.col("t")).alias("s"), T.lines(F.col("t")).alias("l")).collect()
    for r in rows:
        t = TEXTS[r["i"]]
        assert r["w"] == words_of(t)
        assert r["s"] == sentences_of(t)
        assert r["l"] == [x.rstrip() for x in t.splitlines() if x.strip()]


def test_ngrams_and_preview(spark):
    r = spark.createDataFrame([(["a", "b", "c"], "x  y\n" + "z" * 200)], "w array<string>, t string").select(T.ngrams(F.col("w"), 2), T.ngrams(F.col("w"), 4), T.preview(F.col("t"))).first()
    assert r[0] == [["a", "b"], ["b", "c"]] and r[1] == [] and len(r[2]) == 120 and r[2].endswith("...")


def test_language_guard(spark):
    texts = {"the cat and the dog were in the house with a man": None, "le chat et les chiens dans la maison avec une femme pour vous": "foreign", "кошка и собака": "script", "id name size 12 ok": None}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", language.reason_code(T.words(F.col("t"))).alias("r"), language.non_english_reason(T.words(F.col("t"))).alias("why")).collect()
    assert {r["t"]: r["r"] for r in rows} == texts
    assert all((r["r"] is None) == (r["why"] is None) for r in rows)
