import gzip
import random

import pytest

from corpuscope import registry
from corpuscope.operators import dedup
from corpuscope.operators.components import running_total
from corpuscope.sources import readers


def test_readers(spark, tmp_path):
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "x.txt").write_text("no")
    (tmp_path / "a.txt").write_text("plain text")
    (tmp_path / "blank.txt").write_text("  \n")
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write('{"id": "d1", "content": "hello"}\n\nnot json\n[1]\n{"id": 7, "text": " ", "body": "by body", "label": "human"}\n{"text": 5}\n')
    rows = {r["text"]: r for r in readers.read_corpus(spark, str(tmp_path)).collect()}
    assert set(rows) == {"plain text", "hello", "by body"}
    assert rows["hello"]["doc_id"] == "d1" and rows["plain text"]["doc_id"] == "a.txt" and rows["by body"]["label"] == "human"
    assert rows["hello"]["source"] == "b.jsonl.gz" and rows["by body"]["doc_id"] == "b.jsonl.gz#5" and dict(rows["by body"]["meta"]) == {"id": "7", "text": " ", "label": "human"}
    assert readers.read_corpus(spark, str(tmp_path), min_chars=6).count() == 2
    assert [r["text"] for r in readers.read_corpus(spark, f"file://{tmp_path}", limit=2).collect()] == ["plain text", "hello"]
    assert readers.read_corpus(spark, f"{tmp_path}/*.txt").count() == 1
    with gzip.open(tmp_path / "bad.jsonl.gz", "wb") as f:
        f.write(b'{"id": "x", "text": "a\xff b"}\n')
    assert readers.read_corpus(spark, str(tmp_path / "bad.jsonl.gz")).first()["text"] == "a\ufffd b"
    with pytest.raises(readers.CorpusError):
        readers.read_corpus(spark, str(tmp_path / "none"))


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for name in ("a", "b"):
            (tmp_path / f"{name}.jsonl").write_text("".join("\n" if i % 7 == 3 else f'{{"text": "{name} {i} {"x" * (i % 90)}"}}\n' for i in range(1, 800)))
        got = readers.read_corpus(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(got) == 2 * sum(i % 7 != 3 for i in range(1, 800))
    assert all(r["doc_id"] == "{0}.jsonl#{1}".format(*r["text"].split()[:2]) for r in got)


def test_registry():
    state = registry.snapshot()
    registry.register("own_signal", "artifact")(lambda df: df)
    assert "own_signal" in registry.listing()["artifact"]
    with pytest.raises(ValueError):
        registry.register("mtld", "artifact")(lambda df: df)
    registry.restore(state)
    assert "own_signal" not in registry.listing()["artifact"]


def test_near_duplicates(spark):
    rng = random.Random(0)
    vocab = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(2000)]
    docs, family = [], {}
    for f in range(10):
        base = [rng.choice(vocab) for _ in range(400)]
        for c in range(4):
            text = [rng.choice(vocab) if c and rng.random() < 0.005 else w for w in base]
            family[len(docs)] = f
            docs.append(" ".join(text))
    docs += [" ".join(rng.choice(vocab) for _ in range(400)) for _ in range(40)] + ["too short", None]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in dedup.find_near_duplicates(df).collect()}
    assert len(rows) == len(docs) and rows[81]["short"] and rows[80]["short"]
    clusters = {}
    for i, f in family.items():
        clusters.setdefault(f, set()).add(rows[i]["cluster"])
    assert all(len(c) == 1 and None not in c for c in clusters.values()) and len(set.union(*clusters.values())) == 10
    assert all(rows[i]["cluster"] is None for i in range(40, 80))
    with pytest.raises(ValueError):
        dedup.find_near_duplicates(df, 0)


def test_running_total(spark):
    """Totals across range parts, with ties, a hot value, a weight of zero, and an empty table."""
    rows = [(i, min(i, 40), i % 3) for i in range(200)]
    df = spark.createDataFrame(rows, "i long, k long, w long").repartition(7)
    got = {r["i"]: r["upto"] for r in running_total(df, ["k", "i"], "w", "upto").collect()}
    total, want = 0, {}
    for i, _, w in sorted(rows, key=lambda r: (r[1], r[0])):
        total += w
        want[i] = total
    assert got == want
    assert running_total(df.where("false"), ["k"], "w", "upto").count() == 0


def test_buckets_are_compared_to_the_last_member(spark, monkeypatch):
    """One bucket of texts that share a passage, and two copies of each, in turns of any size."""
    monkeypatch.setattr(dedup, "BANDS", 1)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(8))
    passage = [word() for _ in range(300)]
    part = dedup.signature(passage)[: dedup.ROWS].tolist()
    assert min(part) >= 0
    texts = []
    while len(texts) < 6:
        words = passage + [word() for _ in range(120)]
        if dedup.signature(words)[: dedup.ROWS].tolist() == part:
            texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts * 3)), "doc_id long, text string")
    runs = [dedup.near_duplicates(df, block=n) for n in (100, 3, 1)]
    first, *others = [({r["doc_id"]: tuple(r) for r in run.rows.collect()}, run.pairs_checked) for run in runs]
    assert others == [first, first] and len({r[1] for r in first[0].values()}) == 6
    assert all(first[0][i][1] == first[0][i % 6][1] is not None for i in range(18))


def test_near_duplicates_of_repeated_and_named_rows(spark):
    long = " ".join(f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200))
    rows = [("a", long), ("a", long), (None, long), ("b", "short"), ("b", None)]
    run = dedup.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string"))
    filled = round(int((dedup.signature(long.split()) >= 0).sum()) / 64, 4)
    got = sorted((tuple(r) for r in run.rows.collect()), key=str)
    assert got == sorted([("a", 0, 3, filled, False)] * 2 + [(None, 0, 3, filled, False), ("b", None, 1, 0.0, True), ("b", None, 1, 0.0, True)], key=str)
    empty = dedup.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string").where("false"))
    assert empty.rows.count() == 0 and dedup.summary(empty).first()["compared"] == 0


def test_reference_mode_scores_every_document(spark):
    from corpuscope import queries

    sf = "/root/testdata/sf0.001"
    got = queries.reference_mode(spark, sf).select("doc_id").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
