import random
from itertools import pairwise

import pyarrow as pa
import pytest
from test_signals import brute_bits

from corpuscope.operators import language_model as lm, signals as S


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(7)
    return [(i, " ".join(rng.choice("abcdefghijkl") + rng.choice(("", "", "é", "x")) for _ in range(rng.randint(1, 90)))) for i in range(60)] + [(99, ""), (100, None)]


def test_surprisal_moves_no_row_per_ngram(spark, docs):
    """rows between tasks are a few for each block and bucket, however many words there are."""
    df = spark.createDataFrame([(i, t) for i, t in docs if t] * 20, "doc_id long, text string").repartition(2)
    model = lm.fit(df)
    assert model.n_tokens > 20_000
    assert model.rows.count() <= 2 * (1 + lm._buckets(df))


def test_small_blocks_and_buckets_give_the_same_bits(spark, docs, monkeypatch):
    """many blocks and merged tables change nothing; texts without words keep their row."""
    monkeypatch.setattr(lm, "BLOCK_WORDS", 100)
    monkeypatch.setattr(lm, "BUCKET_CHARS", 300)
    monkeypatch.setattr(lm, "AT_ONCE", 16)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in lm.surprisal_signals(df, lm.fit(df)).collect()}
    assert set(got) == {i for i, _ in docs} and got[99]["mean_surprisal"] is None and got[100]["mean_surprisal"] is None
    words = {i: S.words_of(t or "") for i, t in docs}
    for i in range(60):
        bits = brute_bits([w for j, w in words.items() if j != i], words[i])
        assert abs(got[i]["mean_surprisal"] - sum(bits) / len(bits)) < 1e-9
        assert got[i]["predictable_run_fraction"] == lm.run_fraction(bits)


def _levels(block: lm._Block) -> list[tuple]:
    return [lm._of_level(block.two), lm._of_level(block.three)]


def _answer(texts: list[list[str]], buckets: int, at_once: int) -> list[tuple]:
    """All buckets' rows for blocks of the texts, one text a block."""
    import numpy as np
    import xxhash

    rows = []
    for k, words in enumerate(texts):
        vocabulary = list(dict.fromkeys(words))
        block = lm._Block(np.array([xxhash.xxh3_64_intdigest(w) for w in vocabulary], dtype=np.uint64), np.array([vocabulary.index(w) for w in words]), np.array([len(words)]))
        rows += [(k, b, lm._QUESTION, data) for b, data in lm._questions(_levels(block), buckets)]
    out = []
    for b in range(buckets):
        if mine := [r for r in rows if r[1] == b]:
            out += lm._bucket(True, True, at_once)(pa.Table.from_batches([lm._rows(mine)])).to_pylist()
    return out


def test_more_histories_than_a_key_holds(monkeypatch):
    """histories beyond a key's bits are taken in parts, in blocks and in buckets."""
    rng = random.Random(1)
    texts = [[rng.choice("abcdefgh") for _ in range(50)] for _ in range(6)]
    plain = _answer(texts, 3, 1 << 20)
    monkeypatch.setattr(lm, "_MOST_RANKS", 4)
    assert _answer(texts, 3, 1 << 20) == plain and _answer(texts, 3, 8) == plain


def test_packed_arrays_come_back():
    import numpy as np

    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 7, 300):
        codes = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        children = rng.integers(0, 1 << 44, n, dtype=np.uint64)
        counts = rng.choice([0, 1, 254, 255, 256, 1 << 40], n)
        a, b, c, d = lm._unpacked(lm._packed([lm._sorted_bytes(codes), lm._child_bytes(children), *lm._small(counts)]))
        assert (lm._of_sorted(a) == codes).all() and (lm._of_children(b, n) == children).all() and (lm._of_small(c, d) == counts).all()


def test_runs_of_recurring_texts(spark):
    """runs below one bit across block borders."""
    text = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i % 7)}" for i in range(150))
    df = spark.createDataFrame([(i, text) for i in range(9)] + [(20, "other words only")], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["predictable_run_fraction"] for r in lm.surprisal_signals(df, lm.fit(df)).collect()}
    bits = brute_bits([text.split()] * 8 + [["other", "words", "only"]], text.split())
    assert got[0] == lm.run_fraction(bits) > 0.9 and got[20] == 0


def test_reference_mode_asks_the_models_totals(spark, docs):
    """other documents are answered from packed totals: no row per n-gram, coverage from the same pass."""
    known, other = docs[:30], docs[30:]
    a, b = (spark.createDataFrame(x, "doc_id long, text string").repartition(2) for x in (known, other))
    model = lm.fit(a, keep_rows=False, keep_totals=True)
    assert model.totals.count() <= lm._buckets(a)
    got = {r["doc_id"]: r["mean_surprisal"] for r in lm.surprisal_signals(b, model, False).collect()}
    corpus = [S.words_of(t or "") for _, t in known]
    pairs = {p for w in corpus for p in pairwise(["<s>", *w])}
    hits = n = 0
    for i, t in other:
        if t:
            bits = brute_bits(corpus, S.words_of(t))
            assert abs(got[i] - sum(bits) / len(bits)) < 1e-9
            hits += sum(p in pairs for p in pairwise(["<s>", *S.words_of(t)]))
            n += len(bits)
    assert abs(lm.audited_coverage(b, model) - hits / n) < 1e-12


def test_summary_keeps_one_row_a_bucket(spark, docs):
    """sums come from buckets; entries are the distinct n-grams of all three lengths."""
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    model = lm.fit(df, keep_rows=False)
    seqs = [["<s>", "<s>", *S.words_of(t)] for _, t in docs if t]
    grams = [[tuple(s[i - k + 1 : i + 1]) for s in seqs for i in range(2, len(s))] for k in (1, 2, 3)]
    assert model.rows is None and model.totals is None
    assert (model.n_documents, model.n_tokens, model.vocabulary) == (60, len(grams[0]), len(set(grams[0])))
    assert model.entries == sum(len(set(g)) for g in grams) and model.first_types == len({s[2] for s in seqs})
    counts = {g: grams[1].count(g) for g in set(grams[1])}
    assert model.coverage == sum(n for n in counts.values() if n > 1) / len(grams[0])
