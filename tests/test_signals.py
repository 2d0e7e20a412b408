import math
import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from corpuscope.operators import language_model as lm, signals as S


def test_signal_cases():
    assert S.mtld_pass(["a", "b", "c"]) == 3.0
    assert S.branching(["a"] * 3) is None
    words = [f"w{i % 7}" for i in range(400)]
    assert S.branching(words) == 0.0
    assert S.growth(words[:99]) is None
    assert S.stem("component's") == "component" and S.stem("costing") == S.stem("costs") == "cost"
    assert S.reasoning(["short."])["step_novelty"] is None
    assert S.repetition(["a"] * 39, 4) is None and S.repetition(["a"] * 40, 4) == 1 - 1 / 37


def test_artifacts(spark):
    text = "Certainly! Here's the plan. As an AI language model, I can't help with that. It's important to note the rich tapestry. Moreover, we delve."
    r = spark.createDataFrame([(1, text), (2, None), (3, "lol i'm here!! it’s don't")], "doc_id long, text string")
    rows = {x["doc_id"]: x for x in S.artifact_signals(r).collect()}
    n = len(S.words_of(text))
    assert rows[1]["assistant_echo_rate"] == 3 * 1000 / n
    assert rows[1]["llm_lexicon_rate"] == 2 * 1000 / n
    assert rows[1]["transition_rate"] == 1 / len(S.sentences_of(text))
    assert rows[2]["hedging_rate"] is None
    assert rows[3]["human_noise_rate"] == 4 * 1000 / 5


def brute_bits(corpus: list[list[str]], words: list[str]) -> list[float]:
    counts, followed, kinds = Counter(), Counter(), Counter()
    for w in corpus:
        s = ["<s>", "<s>", *w]
        for i in range(2, len(s)):
            for k in (1, 2, 3):
                counts[tuple(s[i - k + 1 : i + 1])] += 1
    for g, c in counts.items():
        if len(g) > 1:
            followed[g[:-1]] += c
            kinds[g[:-1]] += 1
    n, v = sum(c for g, c in counts.items() if len(g) == 1), sum(len(g) == 1 for g in counts)

    def p(g):
        if len(g) == 1:
            return (counts[g] + 1) / (n + v + 1)
        x = followed[g[:-1]]
        return p(g[1:]) if x <= 0 else max(counts[g] - 0.75, 0) / x + 0.75 * kinds[g[:-1]] / x * p(g[1:])

    s = ["<s>", "<s>", *words]
    return [-math.log2(p(tuple(s[i - 2 : i + 1]))) for i in range(2, len(s))]


def test_leave_one_out_equals_removal(spark):
    rng = random.Random(3)
    docs = {i: [rng.choice("abcdefgh") for _ in range(rng.randint(1, 60))] for i in range(12)}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()] + [(99, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm.surprisal_signals(df, lm.fit(df)).collect()}
    for i, w in docs.items():
        bits = brute_bits([x for j, x in docs.items() if j != i], w)
        assert abs(got[i]["mean_surprisal"] - sum(bits) / len(bits)) < 1e-9
    assert got[99]["mean_surprisal"] is None


def test_runs():
    assert lm.run_fraction([0.5] * 5 + [2.0]) == 5 / 6
    assert lm.run_fraction([0.5] * 4 + [2.0]) == 0
    assert lm.run_fraction([1.0] * 9) == 0


def plain_mtld(words, threshold=0.72):
    factors, types, n = 0.0, set(), 0
    for w in words:
        types.add(w)
        n += 1
        if len(types) / n <= threshold:
            factors, types, n = factors + 1, set(), 0
    if n:
        factors += (1 - len(types) / n) / (1 - threshold)
    return len(words) / factors if factors else float(len(words))


def plain_slope(points):
    mx, my = (sum(p[k] for p in points) / len(points) for k in (0, 1))
    sxx, sxy, syy = sum((x - mx) ** 2 for x, _ in points), sum((x - mx) * (y - my) for x, y in points), sum((y - my) ** 2 for _, y in points)
    return sxy / sxx if not syy or sxy * sxy / (sxx * syy) >= 0.5 else None


def test_sequential_measures_equal_plain_ones(spark):
    """Both passes of MTLD, the prefix fit of Heaps, the compressed share."""
    rng = random.Random(11)
    texts = [" ".join(f"w{chr(97 + min(25, int(rng.expovariate(0.15))))}{chr(97 + min(25, int(rng.expovariate(0.3))))}" for _ in range(rng.choice((20, 60, 99, 100, 700)))) for _ in range(40)]
    df = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in S.text_signals(df).collect()}
    assert got[99]["mtld"] is None and got[99]["compression_ratio"] is None
    for i, t in enumerate(texts):
        words = t.split()
        want = (plain_mtld(words) + plain_mtld(words[::-1])) / 2 if len(words) >= 50 else None
        assert got[i]["mtld"] == want or abs(got[i]["mtld"] - want) < 1e-9
        if len(words) >= 100:
            marks = sorted({int(math.exp(math.log(50) + k * (math.log(len(words)) - math.log(50)) / 11)) for k in range(12)})
            slope = plain_slope([(math.log(p), math.log(len(set(words[:p])))) for p in marks if 50 <= p <= len(words)])
            assert got[i]["heaps_beta"] == slope or abs(got[i]["heaps_beta"] - slope) < 1e-9
        else:
            assert got[i]["heaps_beta"] is None
        raw = t.encode()
        assert got[i]["compression_ratio"] == (len(zlib.compress(raw, 6)) / len(raw) if len(raw) >= 500 else None)


def test_step_novelty_equals_plain_sets():
    """R2-R4 on chains of steps with new and repeated content."""
    rng = random.Random(5)
    for _ in range(30):
        steps = [{f"term{chr(97 + rng.randint(0, 12))}{chr(97 + rng.randint(0, 3))}" for _ in range(rng.randint(0, 6))} for _ in range(rng.randint(3, 12))]
        got = S.reasoning([" ".join(["the", *sorted(x), "and"]) + "." for x in steps])
        kept = [x for x in steps if len(x) > 1]
        if len(kept) < 5:
            assert got["step_novelty"] is None
            continue
        fresh = [len(x - set().union(*kept[max(0, i - 3) : i])) / len(x) for i, x in enumerate(kept) if i]
        assert abs(got["step_novelty"] - sum(fresh) / len(fresh)) < 1e-12 and got["stalled_step_ratio"] == sum(f < 0.25 for f in fresh) / len(fresh)


def test_sentence_spread():
    """Means of sentences of three words or more, four at least; withheld where words do not add up."""
    import numpy as np

    text = "One two three. Four five. Six seven eight nine. Ten eleven twelve. A b c d e."
    bits = np.arange(17, dtype=float)
    means = [bits[0:3].mean(), bits[5:9].mean(), bits[9:12].mean(), bits[12:17].mean()]
    assert abs(lm.sentence_spread(text, bits) - np.std(means)) < 1e-12
    assert lm.sentence_spread(text, bits[:-1]) is None and lm.sentence_spread("One two three. Four five six.", bits[:6]) is None


def test_spread_signals_need_coverage(spark):
    """N12, N13 are given above their coverage: a small vocabulary, where word pairs recur."""
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice("abcd") + rng.choice(("", "", ".")) for _ in range(80))) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = lm.fit(df)
    assert model.coverage >= 0.85
    got = {r["doc_id"]: r for r in lm.surprisal_signals(df, model).collect()}
    for i, t in docs:
        bits = brute_bits([S.words_of(x) for j, x in docs if j != i], S.words_of(t))
        mean = sum(bits) / len(bits)
        assert abs(got[i]["surprisal_std"] - (sum((b - mean) ** 2 for b in bits) / len(bits)) ** 0.5) < 1e-9
    model.coverage = 0.8
    assert lm.surprisal_signals(df, model).where("sentence_surprisal_std is not null").count() == 0
