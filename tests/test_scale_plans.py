from pyspark.sql import functions as F

from corpuscope.operators import fusion as fu


def test_filters_on_scores_hold_no_null_values(spark):
    """F8: a filter on the score is pushed below it; the null distributions must not stand in it once a value."""
    null = [i / 1000 + 0.123456 for i in range(201)]
    cal = fu.Calibration({f: 2.0 for f in fu.FAMILIES}, {f: -2.0 for f in fu.FAMILIES}, {f: null for f in fu.FAMILIES}, null, {})
    z = spark.range(8).select("id", *[(F.col("id") / 20 + i / 50).alias(f"z_{f}") for i, f in enumerate(fu.FAMILIES)])
    scored = fu.with_statistic(fu.with_percentiles(z, cal), cal).withColumn("score", 100 * fu.mid_rank_column(cal.score_null, F.col("statistic")))
    plan = scored.where("score is not null").orderBy("score")._jdf.queryExecution().optimizedPlan().toString()
    assert "0.123456" not in plan and "lambdafunction" not in plan


def test_mid_ranks_equal_plain_ones(spark):
    """F11 with ties, and null."""
    null = [0.0, 0.0, 0.5, 1.0]
    values = [None, -1.0, 0.0, 0.25, 0.5, 2.0]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", fu.mid_rank_column(null, F.col("v")).alias("r")).collect()
    assert {r["v"]: r["r"] for r in got} == {v: 0.0 if v is None else fu.mid_rank(null, v) for v in values}


def test_python_workers_get_bounded_batches(spark):
    """a batch holds neither many rows nor many bytes, whatever the length of the texts."""
    import pyarrow as pa

    from corpuscope.operators.components import ARROW_BYTES, ARROW_ROWS, spread

    def largest(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["rows", "bytes"])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    for words, n in ((400, 9000), (2, 30000)):
        docs = spark.range(n).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), words).alias("text")).coalesce(1)
        seen = spread(docs).mapInArrow(largest, "rows long, bytes long").agg(F.max("rows"), F.max("bytes"), F.sum("rows")).first()
        assert seen[0] <= ARROW_ROWS and seen[1] <= 2 * ARROW_BYTES and seen[2] == n


def test_few_texts_at_a_time_are_python_strings():
    """the pass over texts turns a batch into strings by small slices."""
    import pyarrow as pa

    from corpuscope.operators import signals as S
    from corpuscope.operators.components import texts_of

    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(300)), "text": [None, *["One step here. Two steps there."] * 299]})
    assert [x for x, _ in texts_of(batch, "doc_id")] == list(range(300)) and next(texts_of(batch))[1] == ""
    asked = []

    class Seen:
        schema, num_rows, columns = batch.schema, batch.num_rows, batch.columns

        def column(self, k):
            return self

        def slice(self, low, n):
            asked.append(n)
            return batch.column(1).slice(low, n)

    out = next(S._pass(S.REASONING, None)(iter([Seen()])))
    assert out.num_rows == 300 and max(asked) <= 128


def test_signatures_take_few_texts_at_a_time():
    """so do the signatures of near-duplicates; no list of a whole batch's texts is made."""
    import pyarrow as pa

    from corpuscope.operators import dedup

    text = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    batch = pa.RecordBatch.from_pydict({"row": list(range(300)), "doc_id": list(range(300)), "text": [None, *[text] * 299]})

    asked = []

    class Seen:
        schema, num_rows = batch.schema, batch.num_rows

        def column(self, k):
            return batch.column(k) if k in ("row", "doc_id") else self

        def slice(self, low, n):
            asked.append(n)
            return batch.column(2).slice(low, n)

    out = next(dedup._signed(iter([Seen()])))
    assert max(asked) <= 128
    assert out.num_rows == 300 and out.column("sig")[0].as_py() is None and out.column("sig")[1].as_py() == dedup.signature(text.split()).tolist()


def test_artifacts_are_found_in_the_pass_over_texts(spark):
    """no pattern is a column expression, and a query computes its own rates only."""
    from corpuscope.operators import signals as S

    texts = ["", "Sure, here’s it. I ſaid: it's WORTH noting that, as an AI model, we delve!!\nMoreover, i'm done. Dr. However left.", "**A**: x\n**B:** y\nz\n- **C**: u\n\n v\r\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rates = S.artifact_signals(df, ("llm_lexicon_rate", "transition_rate"))
    assert rates.columns == ["doc_id", "llm_lexicon_rate", "transition_rate"] and "regexp" not in rates._jdf.queryExecution().optimizedPlan().toString()
    got = {r["doc_id"]: r for r in S.artifact_signals(df).collect()}
    n = len(S.words_of(texts[1]))
    assert got[1]["llm_lexicon_rate"] == 1000 / n and got[1]["assistant_echo_rate"] > 0 and got[1]["human_noise_rate"] == 3 * 1000 / n
    assert got[1]["transition_rate"] == 1 / len(S.sentences_of(texts[1])) and got[1]["bold_lead_rate"] is None
    assert got[2]["bold_lead_rate"] == 3 / 5 and all(got[0][c] is None for c in S.ARTIFACT)


def test_self_calibration_keeps_no_ngrams_and_plain_filters(spark):
    """The step that all these queries share leaves nothing in the executors' stores, and its scores are filtered as they are."""
    import random

    from corpuscope.plans.score import self_calibrated

    rng = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(("the", "of", "and", "to", "in")) + rng.choice(("", " ", "x ")) + rng.choice("abcdefgh") for _ in range(80))) for i in range(120)], "doc_id long, text string")
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    rows, run = self_calibrated(docs, families=("distributional", "surprisal"))
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
    assert set(run.calibration.thresholds) == {"distributional", "surprisal"}
    plan = rows.where("score is not null").select("doc_id", "score")._jdf.queryExecution().optimizedPlan().toString()
    filters = [x for x in plan.splitlines() if x.lstrip(" :+-").startswith("Filter")]
    assert filters and not any("lambdafunction" in x for x in filters)
    assert rows.where("score is not null").count() == rows.where("analysable").count() > 60
