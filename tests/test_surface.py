import io
import json
import random

import pytest

from corpuscope import cli, registry, report
from corpuscope.constants import TIERS
from corpuscope.operators import fusion as fu, language_model as lm
from corpuscope.plans import profile as prof, score
from corpuscope.sources import readers

WORDS = "the of and to in is it that was for on are as with be river stone light house water tree bird cloud road hill market garden winter summer letter story".split()


def corpus(n, seed=1, words=90):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) + ("." if rng.random() < 0.08 else "") for _ in range(words + rng.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def trusted(spark):
    rows = [(f"d{i}", t, ("a", "b")[i % 2], ("human", "synthetic")[i % 5 == 0]) for i, t in enumerate(corpus(220))]
    return spark.createDataFrame(rows, "doc_id string, text string, genre string, label string")


@pytest.fixture(scope="module")
def calibrated(trusted):
    return score.calibrate_corpus(trusted, likely_target=0.1, min_documents=40).calibration


def test_reports(trusted, calibrated):
    done = score.score_corpus(trusted, calibrated, top_n=3)
    text = report.render_markdown(done.meta, done.top)
    assert "LIKELY_SYNTHETIC" in text and all(c in text for c in report.CAVEATS)
    page = report.render_html(done.meta | {"notes": ["<b>"]}, done.top)
    assert "<svg" in page and "&lt;b&gt;" in page and "<b>" not in page and "src=" not in page
    assert json.loads(report.render_json(done.meta, done.top))["top"]
    assert report.explain(done.top[0]).startswith(str(done.top[0]["doc_id"]))
    assert set(done.meta["labels"]) == {"human", "synthetic"} and sum(done.meta["labels"]["human"].values()) == 176
    assert sum(done.meta["tiers"].values()) == 220 == done.rows.count()
    scores = [d["score"] for d in done.top]
    assert len(scores) == 3 and scores == sorted(scores, reverse=True)


def test_groups_and_notes(trusted, calibrated):
    done = score.score_corpus(trusted, calibrated, stratify_by="genre", top_n=1)
    assert any("genre: a, b" in n for n in done.meta["notes"]) and any("calibration was made by no group" in n for n in done.meta["notes"])
    few = score.score_corpus(trusted.limit(10), calibrated, top_n=1)
    assert any("only 10 documents" in n for n in few.meta["notes"])


def test_reference_mode_notes_what_the_reference_lacks(spark, trusted, calibrated):
    other = spark.createDataFrame([(i, " ".join(f"{w}{chr(97 + i)}" for w in t.split())) for i, t in enumerate(corpus(12, seed=9))], "doc_id long, text string")
    done = score.score_corpus(other, calibrated, reference=trusted, guard=False, top_n=1)
    assert done.meta["mode"] == "reference" and any("withheld" in n for n in done.meta["notes"]) and done.rows.count() == 12


def test_repeated_and_null_ids_are_rows_of_their_own(spark):
    text = corpus(1)[0]
    docs = spark.createDataFrame([("a", text), ("a", text), (None, text), ("b", "short"), (None, None)], "doc_id string, text string")
    rows = prof.profile(docs).rows.collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["None", "None", "a", "a", "b"]
    assert len({r["mean_surprisal"] for r in rows if r["analysable"]}) == 1 and sum(r["analysable"] for r in rows) == 3


def test_a_registered_signal_is_judged(spark, trusted):
    state = registry.snapshot()
    try:
        registry.register("vowels", "reasoning", -1, "vowels per character")(lambda df: df.withColumn("vowels", lm.F.regexp_count("text", lm.F.lit("[aeiou]")) / lm.F.length("text")))
        registry.register_contextual("place", "distributional")(lambda docs, model: docs.select("__row", (lm.F.length("text") % 7).cast("double").alias("place")))
        registry.register_contextual("declined", "surprisal")(lambda docs, model: None)
        run = score.calibrate_corpus(trusted, likely_target=0.1, min_documents=40)
        assert "reasoning" in run.calibration.thresholds and "vowels" in run.calibration.signals
        done = score.score_corpus(trusted, run.calibration, top_n=220)
        assert done.rows.count() == 220
        seen = {e["signal"] for d in done.top for e in d["evidence"]}
        assert {"vowels", "place"} <= seen and "declined" not in seen
        with pytest.raises(ValueError):
            registry.register("x", "artifact", 2)(lambda df: df)
    finally:
        registry.restore(state)
    assert "vowels" not in registry.catalog()


def test_documents_of_another_corpus_are_refused(spark):
    a, b = (spark.createDataFrame([(i, t) for i, t in enumerate(corpus(4, seed=s))], "doc_id long, text string") for s in (1, 2))
    model = lm.fit(a)
    model.rows = None
    with pytest.raises(Exception, match="not among those|more words"):
        lm.surprisal_signals(b.unionByName(b), model).collect()


def test_stored_runs(spark, trusted, calibrated, tmp_path):
    done = score.score_corpus(trusted, calibrated, top_n=2)
    readers.write_run(done, f"file://{tmp_path}/run")
    rows, told = readers.load_run(spark, f"file://{tmp_path}/run")
    assert rows.count() == 220 and told["meta"]["tiers"] == done.meta["tiers"] and len(told["top"]) == 2
    with pytest.raises(readers.CorpusError):
        readers.load_run(spark, str(tmp_path / "none"))


def test_streams_are_scored_against_a_frozen_reference(spark, trusted, calibrated, tmp_path):
    from corpuscope.streaming.score import score_stream

    texts = lm.by_row(trusted)[0]
    model = lm.fit(texts)
    stats = fu.reference_stats(prof.profile(trusted, model=model, of_model=True).rows)
    trusted.select("doc_id", "text").limit(30).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("doc_id string, text string").parquet(f"{tmp_path}/in")
    query = score_stream(stream, stats, model, calibrated, f"{tmp_path}/out", f"{tmp_path}/state")
    assert query.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == 30 and set(r["tier"] for r in got.select("tier").distinct().collect()) <= set(TIERS)


def test_command_line(tmp_path, capsys, monkeypatch):
    lines = [json.dumps({"id": f"d{i}", "text": t, "genre": "ab"[i % 2], "label": "human"}) for i, t in enumerate(corpus(230, words=60))]
    # Copies of a long text: in a short one, empty bins count as unlike.
    lines[0] = json.dumps({"id": "d0", "text": corpus(1, words=400)[0], "genre": "a", "label": "human"})
    (tmp_path / "c.jsonl").write_text("\n".join([lines[0], lines[0], *lines]))
    path = str(tmp_path / "c.jsonl")
    assert cli.main(["families"]) == 0
    assert cli.main(["profile", path, "--json", "--family", "distributional", "--out", f"{tmp_path}/rows"]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["n_documents"] == 232
    assert cli.main(["inspect", path, "-n", "2", "--limit", "5"]) == 0
    told = capsys.readouterr().out
    assert "d0 [human]" in told and "first words" not in told and "unigram_entropy" in told
    assert cli.main(["calibrate", path, "--out", f"{tmp_path}/cal.json", "--likely-target", "0.2", "--stratify-by", "genre"]) == 0
    assert cli.main(["score", path, "--calibration", f"{tmp_path}/cal.json", "--out", f"{tmp_path}/run", "--report", f"{tmp_path}/r.html", "--top", "2", "--stratify-by", "genre"]) == 0
    assert (tmp_path / "r.html").read_text().startswith("<!doctype html>")
    capsys.readouterr()
    assert cli.main(["explain", f"{tmp_path}/run", "d7"]) == 0 and "d7" in capsys.readouterr().out
    assert cli.main(["explain", f"{tmp_path}/run", "none"]) == 1
    assert cli.main(["report", f"{tmp_path}/run", "--format", "json", "-o", f"{tmp_path}/r.json"]) == 0 and json.loads((tmp_path / "r.json").read_text())["top"]
    assert cli.main(["dedup", path, "--top", "1"]) == 0 and '"clusters": 1' in capsys.readouterr().out
    assert cli.main(["dedup", str(tmp_path / "none")]) == 2
    assert cli.main(["dedup", path, "--threshold", "0"]) == 2
    monkeypatch.setattr("sys.stdin", io.StringIO('{"text": "one two"}\n\n{"text": "three"}\n'))
    assert cli.main(["profile", "-", "--json"]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["n_documents"] == 2
    monkeypatch.setattr("sys.stdin", io.StringIO(""))
    assert cli.main(["inspect", "-"]) == 1
    (tmp_path / "few.jsonl").write_text(lines[0])
    assert cli.main(["calibrate", str(tmp_path / "few.jsonl"), "--out", str(tmp_path / "o.json")]) == 2

    def interrupted(a):
        raise KeyboardInterrupt

    monkeypatch.setattr(cli, "_run", interrupted)
    assert cli.main(["profile", path]) == 130
