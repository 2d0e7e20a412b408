import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscope.llm import fm_index, line_dedup, ngram_join, ogg, packing, quality, sharding, tokens, urls, warc
from corpuscope.llm.common import shared_dir

EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "one two three"), (7, "naïve ½ x²   日本 \x1c end"), (8, "long " * 30_000)]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, "s", 1, "x") for i, t in EDGE], "doc_id long, text string, source string, n_chars long, shard string")


@pytest.fixture(scope="module")
def empty(edge):
    return edge.where("false")


def encoded(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_sharding(spark, edge, empty):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randint(0, 300), "hot" if i % 3 else str(i % 7), None) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    out = sharding.assign_shards(docs, 24).toPandas()
    assert sorted(out.doc_id) == list(range(3000))
    sums = out.groupby("shard")["size"].sum()
    assert len(sums) == 24 and sums.max() <= 1.05 * sums.min()
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    got = sharding.assign_shards(edge, 3)
    assert got.count() == len(EDGE) and got.where("doc_id = 1 and size = 8 and text_crc32 = 0").count() == 1
    assert sharding.assign_shards(empty, 3).count() == 0
    same = sharding.assign_shards(spark.createDataFrame([(1, "a")] * 400, "doc_id long, text string"), 4)
    assert same.count() == 400
    wide = [(i * (1 << 58) - (1 << 63), f"text {i}") for i in range(32)] + [((1 << 63) - 1, "last"), (-5, "near"), (-4, "near too")]
    got = sharding.assign_shards(spark.createDataFrame(wide, "doc_id long, text string"), 5).toPandas()
    assert sorted(got.doc_id) == sorted(i for i, _ in wide) and got.shard.nunique() == 5


def test_sharding_keeps_copies_together_and_equals_a_plain_tree(spark):
    """Against a tree built in memory: cuts at the first point where the bytes reach the goal."""
    rng = random.Random(3)
    rows = [(10 * i, rng.choice([f"copy {j} " * 5 for j in range(60)]) if i % 4 == 0 else "y" * rng.randint(1, 200) + str(i), f"s{rng.randint(0, 5)}") for i in range(1200)]
    rows += [(20 * i + 5, "hot copy", "hot") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    shards = 6
    out = {r["doc_id"]: r for r in sharding.assign_shards(docs, shards, numeric=("doc_id",), categorical=()).collect()}
    total = sum(len(t) + 8 for _, t, _ in rows)
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t].append(i)
        assert out[i]["size"] == len(t) + 8 and out[i]["text_crc32"] == zlib.crc32(t.encode())
    large = {t for t, ids in groups.items() if len(ids) > 1 and len(ids) * (len(t) + 8) * shards * sharding.WHOLE > total}
    assert "hot copy" in large and len({out[i]["shard"] for i in groups["hot copy"]}) > 1
    assert all(len({out[i]["shard"] for i in ids}) == 1 for t, ids in groups.items() if t not in large)
    assert sum(len(ids) > 1 for t, ids in groups.items() if t not in large) > 20
    points = sorted((min(groups[t]) if t not in large else i, i, len(t) + 8) for i, t, _ in rows)

    def split(points, first, n):
        if n == 1:
            return {i: first for _, i, _ in points}
        goal, at, k = -(-sum(w for _, _, w in points) * (n // 2) // n), 0, 0
        while at < goal:
            place = points[k][0]
            while k < len(points) and points[k][0] == place:
                at, k = at + points[k][2], k + 1
        return split(points[:k], first, n // 2) | split(points[k:], first + n // 2, n - n // 2)

    assert {i: r["shard"] for i, r in out.items()} == split(points, 0, shards)


def fitting(host, path, entries):
    """The longest entry that fits, plainly."""
    found = [(len(h), len(p), v, h + p) for h, p, v in entries if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(found)[2:] if found else None


def test_url_filter(spark):
    rng = random.Random(5)
    part = lambda: rng.choice(["www", "a", "b", "example", "spam-farm", "bad", "x", ""])
    urls_ = [".".join(part() for _ in range(rng.randint(1, 4))) + "." + rng.choice(["com", "net", "org", "COM", "example.org"]) + rng.choice(["", "/", "/en/", "/en/x", "/es/", "/fr", "/cracked/y", "?q=/en/", "#/"]) for _ in range(2000)]
    rows = [(i, rng.choice(["http://", "https://", "://", ""]) + u, "taken", "kept") for i, u in enumerate(urls_)]
    rows += [(9000, None, "h", "e"), (9001, "http://", "h", "e"), (9002, "http://" + "a." * 30000 + "com/", "h", "e"), (9003, "HTTP://WWW.Example.com/en/x?q#f", "h", "e"), (9003, "HTTP://WWW.Example.com/en/x?q#f", "h", "e")]
    pages = spark.createDataFrame(rows, "page_id long, u string, __entry string, __url string")
    listed = spark.createDataFrame([("http://bad.com/",), ("http://Spam-Farm.example.org",), ("https://x.org/en/?q",), (None,)], "url string")
    out = urls.filter_urls(pages, urls.contract_rules(spark), listed, "u")
    assert out.columns == ["page_id", "u", "__url", "__host", "__path", "__entry", "__verdict"]
    blocked = [("bad.com", "/", "block"), ("spam-farm.example.org", "/", "block"), ("x.org", "/en/", "block")]
    got = out.collect()
    assert len(got) == len(rows) and {r["__url"] for r in got} == {"kept", "e"}
    for r in got:
        rest = (r["u"] or "").split("://", 1)[1] if "://" in (r["u"] or "") else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate({i: i + 32 for i in range(65, 91)})
        rule = fitting(host, path, urls.RULES)
        want = (host, path, rule[1], rule[0]) if rule else (host, path, None, "block" if fitting(host, path, blocked) else "allow")
        assert (r["__host"], r["__path"], r["__entry"], r["__verdict"]) == want
    none = urls.filter_urls(pages, urls.contract_rules(spark).where("false"), listed.where("false"), "u")
    assert none.where("__entry is not null or __verdict <> 'allow'").count() == 0 and none.count() == len(rows)
    report = urls.filter_report(pages, urls.contract_rules(spark), "u").first()
    assert report["probed"] >= report["possible"] >= report["listed"] > 0 and report["false_positives"] == report["possible"] - report["listed"]


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(5000).select(F.concat(F.lit("h"), "id", F.lit(".com/")).alias("__key"))
    bloom = urls.build_filter(keys, 313)
    assert urls.possible_hits(keys, bloom, 313).count() == 5000
    other = spark.range(5000).select(F.concat(F.lit("o"), "id", F.lit(".com/")).alias("__key"))
    assert urls.possible_hits(other, bloom, 313).count() < 100


def brute_classes(docs, percent=80):
    sets = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
        sets[d] = set(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def near_copies(seed, families, copies, words=60):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(40)]
    docs = []
    for _ in range(families):
        base = [rng.choice(vocab) for _ in range(rng.randint(1, words))] + (passage if rng.random() < 0.4 else [])
        for _ in range(copies):
            rate = rng.choice((0, 0.01, 0.02, 0.05))
            docs.append(" ".join(rng.choice(vocab) if rng.random() < rate else w for w in base))
    return list(enumerate(docs))


@pytest.mark.parametrize(("seed", "families", "copies", "words", "hot"), [(1, 60, 4, 120, 64), (2, 3, 90, 150, 64), (3, 100, 2, 8, 64), (4, 4, 60, 90, 4)])
def test_join_equals_brute_force(spark, monkeypatch, seed, families, copies, words, hot):
    monkeypatch.setattr(ngram_join, "HOT", hot)
    docs = near_copies(seed, families, copies, words)
    got = ngram_join.similar_classes(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute_classes(docs)


def test_join_links_by_words_not_by_regular_hashes(spark):
    """Words of a and b by the parity of the place's bits, and their complements, share no shingle."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = one.translate({97: 98, 98: 97})
    docs = [(i, " ".join([w] * 8)) for i, w in enumerate((one, other))] + [(2, one), (3, other)]
    got = ngram_join.similar_classes(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute_classes(docs)


def test_shared_keys_equal_plain_buckets(monkeypatch):
    """Keys dealt in blocks, hot ones apart, from several tasks: the buckets of two nodes and a probe, whole."""
    monkeypatch.setattr(ngram_join, "HOT_KEYS", 6)
    rng, parts = np.random.default_rng(4), 5
    common = rng.integers(0, 1 << 63, 40)
    entries, rows = [], defaultdict(set)
    for node in range(1, 200):
        keys = np.unique(np.concatenate((rng.choice(common, rng.integers(1, 12), replace=False), rng.integers(0, 1 << 63, 5))))
        kinds = rng.integers(0, 3, len(keys)).astype(np.int8)
        entries.append((keys, kinds, node, 1 + node % 2, node % 7))
        low = keys.astype(np.uint64) & ngram_join._LOW
        for key, kind in zip((ngram_join._place(keys.astype(np.uint64), parts) << 40) | low.astype(np.int64), kinds, strict=True):
            rows[int(key)].add((node, int(kind), 1 + node % 2, node % 7))
    tasks = [ngram_join._blocks(entries[:80], parts), ngram_join._blocks(entries[60:130], parts), ngram_join._blocks(entries[130:], parts)]
    got = defaultdict(set)
    for part in range(parts):
        own = [batch.take([i for i, p in enumerate(batch.column("part").to_pylist()) if p == part]) for batch in tasks]
        for batch in ngram_join._shared(iter(own)):
            for r in batch.to_pylist():
                got[r["key"]].add((r["hash"], r["kind"], r["role"], r["spare"]))
    wanted = {k: v for k, v in rows.items() if len({n for n, *_ in v}) > 1 and any(kind for _, kind, *_ in v)}
    assert {k: got[k] for k in wanted} == wanted
    assert all(v <= rows[k] for k, v in got.items())
    long = [(np.arange(70_000), np.ones(70_000, dtype=np.int8), 7, 1, 3)]
    back = [ngram_join._unblock(*r.values()) for r in ngram_join._blocks(long, 1).to_pylist()]
    assert len(back) == 1 and (np.sort(back[0][0]) == np.arange(70_000)).all() and (back[0][1] == 7).all()


def test_sketches_bound_the_difference(spark):
    rng = np.random.default_rng(6)
    rows, pairs = [], []
    for i in range(60):
        s = np.unique(rng.integers(1, 1 << 60, int(rng.integers(1, 400))).astype(np.uint64))
        t = np.unique(np.concatenate((s[rng.random(len(s)) > 0.15 * rng.random()], rng.integers(1, 1 << 60, int(rng.integers(0, 30))).astype(np.uint64))))
        both = len(np.intersect1d(s, t))
        rows += [(2 * i, len(s), ngram_join.sketch(s).tolist()), (2 * i + 1, len(t), ngram_join.sketch(t).tolist())]
        pairs.append((2 * i, 2 * i + 1, bool(len(t)) and 100 * both >= 80 * (len(s) + len(t) - both)))
    members = spark.createDataFrame(rows, "node long, n int, bits array<long>")
    near = {r["a"] for r in ngram_join._near(spark.createDataFrame(pairs, "a long, b long, linked boolean").select("a", "b"), members, 80).collect()}
    assert {a for a, _, linked in pairs if linked} <= near and len(near) < 60


def test_one_of_each_class(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(7, long, "x"), (7, long, "x"), (7, long, "x"), (9, long + " end", "x"), (None, long, "x"), (None, "no id at all", "x"), (None, "no id at all", "x"), (3, "other text", "x"), (3, "another text", "x"), (4, None, "x"), (4, None, "x"), (5, " ", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __id string")
    kept = sorted((tuple(r) for r in ngram_join.one_of_each_class(docs).collect()), key=str)
    assert kept == sorted([(7, long, "x"), (None, "no id at all", "x"), (3, "other text", "x"), (3, "another text", "x"), (4, None, "x"), (5, " ", "x")], key=str)


def test_join_edges(edge, empty):
    rows = [tuple(r) for r in ngram_join.similar_classes(edge).collect()]
    assert len(rows) == len(EDGE)
    assert (1, 0, 1) in rows and (4, 1, 4) in rows and rows.count((5, 1, 4)) == 2 and (None, 1, None) in rows
    assert ngram_join.similar_classes(empty).count() == 0


def test_allocation_meets_every_linked_pair():
    """Whatever the keys cost: a linked pair shares a key that the larger one's units hold."""
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(1, 200))
        s = np.unique(rng.integers(1, 1 << 60, n).astype(np.uint64))
        r = s[rng.random(len(s)) > rng.random() * 0.2]
        r = np.unique(np.concatenate((r, rng.integers(1, 1 << 60, int(rng.integers(0, 1 + n // 10))).astype(np.uint64))))
        if not len(r):
            continue
        r, s = sorted((r, s), key=len)
        both = len(np.intersect1d(r, s))
        if 100 * both < 80 * (len(r) + len(s) - both):
            continue
        index = {int(k) for role, keys, _, _ in ngram_join.set_keys(r, 80) if role == 1 for k in keys}
        found = 0
        spare = 0
        for _, keys, kinds, spared in ngram_join.set_keys(s, 80):
            hits = sum(int(k) in index for k, kind in zip(keys, kinds, strict=True) if kind)
            found, spare = max(found, hits - spared), spare + spared
        assert found >= 1


def test_quality(spark, edge, empty):
    rng = random.Random(4)
    good = [" ".join(rng.choice(["the", "cat", "sat", "on", "mats", "dogs"]) for _ in range(40)) for _ in range(150)]
    bad = [" ".join(rng.choice(["the", "cat"]) + "$$$ ###" for _ in range(40)) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(good + bad)], "doc_id long, text string, __x long")
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(0, 210, 2)], "doc_id long, quality int, toxic int")
    out = quality.importance_sample(docs, labels).collect()
    assert sum(r["__selected"] for r in out if r["doc_id"] < 150) >= 148
    assert sum(r["__selected"] for r in out if r["doc_id"] >= 150) == 0
    rows = quality.importance_sample(edge, labels.where("false")).collect()
    assert len(rows) == len(EDGE) and not any(r["__selected"] for r in rows if not (r["text"] or "").strip())
    assert quality.importance_sample(empty, labels).count() == 0


def test_importance_equals_plain_sums(spark):
    """Log weights by the two models in memory, noise by its law, and the k largest of their sum with ties."""
    rng = random.Random(6)
    texts = [" ".join(rng.choice("the cat sat on $$ ### mats dogs ä".split()) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    rows = list(enumerate(texts)) + [(900, "the cat")] * 40 + [(None, "the cat sat"), (901, None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, __noise string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 7 == 0)) for i in range(0, 200, 2)] + [(None, 1, 0), (5000, 1, 0)], "doc_id long, quality int, toxic int")
    half = {r["__label_id"]: r["half"] for r in quality._labels(labels, 10_000, quality.SEED, "doc_id").collect()}
    raw, good = defaultdict(int), defaultdict(int)
    grams = {}
    for i, t in rows:
        grams[i, t] = quality._buckets(quality._hashes((t or "").encode())).tolist()
        for b in grams[i, t]:
            raw[b] += 1
            good[b] += i is not None and i < 200 and i % 2 == 0 and i % 3 > 0 and i % 7 > 0 and half[i] == 0
    total, n_good = sum(raw.values()) + quality.BUCKETS, sum(good.values())
    n_fit = sum(half[i] == 0 and i % 3 > 0 and i % 7 > 0 for i in range(0, 200, 2)) + (half[5000] == 0)
    prior = quality.PRIOR_TEXTS
    ratio = {b: np.log((n_fit * good[b] / n_good + prior * (raw[b] + 1) / total) / (n_fit + prior)) - np.log((raw[b] + 1) / total) for b in raw}
    for k in (30, 100):
        out = quality.importance_sample(docs, labels, k=k).collect()
        for r in out:
            assert r["__grams"] == len(grams[r["doc_id"], r["text"]]) and abs(r["__log_weight"] - sum(ratio[b] for b in grams[r["doc_id"], r["text"]])) < 1e-9
        drawn = [r for r in out if r["__selected"]]
        fits = [r for r in out if r["__grams"] and (r["__selected"] or r["__toxicity"] <= max(x["__toxicity"] for x in drawn))]
        assert len(drawn) == k
        keys = sorted((r["__log_weight"] + r["__noise"] for r in fits), reverse=True)
        assert sorted((r["__log_weight"] + r["__noise"] for r in drawn), reverse=True) == keys[:k]
    noise = [r["__noise"] for r in out if r["doc_id"] != 900]
    assert abs(np.mean(noise) - 0.5772) < 0.3 and len(set(noise)) == len(noise)


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    drawn = quality.importance_sample(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    kept = {r["kind"]: r["kept"] for r in quality.held_out_report(drawn, labels).collect()}
    assert kept["good"] >= 0.98 and kept["poor"] <= 0.1 and kept["toxic"] <= 0.05


def test_quality_rejects_toxic_texts_of_good_quality(spark):
    rng = random.Random(4)
    words = ["the", "cat", "sat", "on", "mats", "dogs"]
    texts = [" ".join(rng.choice(["vile", "scum"]) if i % 5 == 0 and j % 10 == 0 else rng.choice(words) for j in range(40)) for i in range(300)]
    bad = [" ".join(rng.choice(["the", "cat"]) + "$$$ ###" for _ in range(40)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts + bad)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 300), int(i < 300 and i % 5 == 0)) for i in range(360) if i % 3], "doc_id long, quality int, toxic int")
    out = quality.importance_sample(docs, labels).collect()
    assert not any(r["__selected"] for r in out if r["doc_id"] % 5 == 0 or r["doc_id"] >= 300)
    assert sum(r["__selected"] for r in out) >= 0.95 * 240


def test_kth(spark):
    rng = random.Random(9)
    values = [rng.gauss(0, 100) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "__key double")
    for k in (1, 777, 2000):
        cut = quality._kth(df, k)
        assert sum(v >= cut for v in values) == k


def test_open_bins():
    rng = random.Random(0)
    bins = packing.OpenBins(100, 8)
    filled = defaultdict(list)
    for _ in range(5000):
        n = rng.randint(1, 100)
        b, at = bins.place(n)
        filled[b].append((at, n))
        assert bins.open <= 8
    for parts in filled.values():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at <= 100
    assert len(filled) < 1.12 * sum(n for p in filled.values() for _, n in p) / 100


def test_packing(spark, edge, empty):
    out = packing.pack_documents(edge, tokens.default_tokenizer(), capacity=64)
    rows = out.collect()
    docs = defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append(r)
    want = dict(zip([i for i, _ in EDGE], encoded([t for _, t in EDGE]), strict=True))
    for d, parts in docs.items():
        ids = [*want[d], 2]
        for r in parts:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes())
            assert r["length"] == 64 or r["piece"] == 0
    assert sum(r["length"] for r in docs[8]) == len(want[8]) + 1
    placed = defaultdict(list)
    for r in rows:
        placed[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in placed.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    whole = defaultdict(int)
    for r in rows:
        whole[r["doc_id"]] += r["length"]
    assert all(whole[d] == (len(want[d]) + 1) * (2 if d == 5 else 1) for d in whole) and set(whole) == {i for i, _ in EDGE}
    assert packing.pack_documents(empty, tokens.default_tokenizer()).count() == 0


def test_warc(spark, tmp_path):
    big = "<p>" + "x" * 200
    rows = [(5, "http://a/", big), (3, "http://b/", big), (9, None, big), (1, "u", "tiny"), (2, "u", "tiny"), (7, "u\r\nX: y", None), (None, "n", big), (11, "ü", "é" * 60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc.write_archives(pages, folder=f"file://{tmp_path}/w")
    got = {r["page_id"]: r for r in warc.read_archives(index).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        data = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
    assert got[3]["record_type"] == "response" and {got[i]["refers_to"] for i in (5, 9, None)} == {3} and got[5]["record_type"] == "revisit"
    assert got[1]["record_type"] == got[2]["record_type"] == "response"
    # Every file can be read alone: its dictionary, a warcinfo record, then the records; ids lead from revisits to responses.
    import zstandard

    ids, refers = set(), set()
    for file in {r["file"] for r in index.collect()}:
        data = open(file.removeprefix("file://"), "rb").read()
        assert int.from_bytes(data[:4], "little") == 0x184D2A5D
        n = int.from_bytes(data[4:8], "little")
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + n])) if n else zstandard.ZstdDecompressor()
        with reader.stream_reader(data[8 + n :], read_across_frames=True) as stream:
            text = stream.read()
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        ids |= set(re.findall(rb"WARC-Record-ID: (\S+)", text))
        refers |= set(re.findall(rb"WARC-Refers-To: (\S+)", text))
        assert text.count(b"HTTP/1.1 200 OK") == text.count(b"X-Page-ID")
    assert len(refers) == 1 and refers <= ids
    assert warc.read_archives(warc.write_archives(pages.where("false"), folder=f"file://{tmp_path}/e")).count() == 0


def brute_hits(docs, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))
    out = {}
    for d, t in docs:
        w, hit, found = low(t), set(), set()
        for item, x in items:
            q = low(x)
            for i in range(max(1, len(q) - window + 1) if q else 0):
                p = q[i : i + window]
                for j in range(len(w) - len(p) + 1):
                    if w[j : j + len(p)] == p:
                        hit.update(range(j, j + len(p)))
                        found.add(str(item))
        out[d] = (len(w), len(hit), sorted(found))
    return out


def test_fm_index_equals_brute_force(spark, edge, empty, monkeypatch):
    monkeypatch.setattr(fm_index, "SHARD_SYMBOLS", 150)
    rng = random.Random(3)
    vocab = ["a", "b", "c", "d", "É"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice((0, 1, 4, 11, 30))))) for i in range(12)] + [(77, None), (78, "only-here 42")]
    items = [(i, t if t is None or len(t.split()) != 1 else "q") for i, t in items]
    docs = []
    for i in range(60):
        w = [rng.choice([*vocab, "zz"]) for _ in range(rng.randint(0, 80))]
        if i % 3 == 0:
            w[3:3] = (rng.choice(items)[1] or "").split()
        docs.append((i, rng.choice((" ", ". ", "\n")).join(w)))
    docs.append((60, None))
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = fm_index.contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert {r["doc_id"]: (r["__n_words"], sum(s["end"] - s["start"] for s in r["__spans"]), r["__items"]) for r in rows} == brute_hits(docs, items)
    assert fm_index.contamination(edge, bench).count() == len(EDGE) and fm_index.contamination(empty, bench).count() == 0
    assert fm_index.contamination(edge, bench.where("false")).where("size(__spans) > 0").count() == 0
    # More phrases than one part may hold: several parts, the same result.
    monkeypatch.setattr(fm_index, "PHRASE_BYTES", 40)
    again = fm_index.contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench, keep=["doc_id"]).collect()
    assert {r["doc_id"]: (r["__n_words"], sum(s["end"] - s["start"] for s in r["__spans"]), r["__items"]) for r in again} == brute_hits(docs, items)
    monkeypatch.setattr(fm_index, "PHRASE_BYTES", 64 << 20)
    assert fm_index.cut_words("x a b, c. y", [(1, 4)]) == "x . y"
    assert fm_index.cut_words("The É-Cat SAT, Down 5 times", [(1, 4), (5, 6)]) == "The , Down  times"
    mixed = fm_index.contamination(spark.createDataFrame([(1, "Keep THIS. One Two\nTHREE four Five six SEVEN eight nine ten! And This")], "doc_id long, text string"), spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string"), cut=True).first()
    assert mixed["text"] == "Keep THIS. ! And This" and mixed["__spans"][0]["start"] == 2


def test_index_search_and_locate():
    rng = np.random.default_rng(0)
    text = rng.integers(1, 6, 500)
    index = fm_index.FMIndex(text, 5)
    for n in (1, 2, 5):
        phrases = rng.integers(1, 6, (20, n))
        low, high = index.search(phrases)
        for p, a, b in zip(phrases, low, high, strict=True):
            want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_ogg(edge, empty):
    for text in (b"", b"a", b"x" * 64, bytes(range(256)) * 1100):
        media = ogg.encode(text)
        n, payload, stream = ogg.decode(media)
        assert n == len(text) and payload == text + bytes(-len(text) % 64 if text else 64)
        assert abs(stream.seconds(8000) - len(payload) / 8000) < 1e-9
        broken = bytearray(media)
        broken[-5] ^= 1
        with pytest.raises(ogg.OggError):
            ogg.decode(bytes(broken))
        with pytest.raises(ogg.OggError):
            ogg.demultiplex(media[:-10])
    crc = 0
    for b in b"OggS test":
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    assert ogg.ogg_crc(b"OggS test") == crc
    rows = ogg.decode_media(ogg.encode_media(edge)).collect()
    texts = dict(EDGE)
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        media = ogg.encode(data)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        x = [b - 128 for b in payload]
        crossings = sum((a >= 0) != (b >= 0) for a, b in zip(x, x[1:]))
        told = dict(p.split("=") for p in r["feature"].split(";"))
        assert int(told["crossings"]) == crossings and abs(float(told["seconds"]) - len(payload) / 8000) < 1e-6
        assert abs(float(told["mean"]) - sum(x) / len(x)) < 1e-3 and abs(float(told["rms"]) - (sum(v * v for v in x) / len(x)) ** 0.5) < 1e-3
    assert len(rows) == len(EDGE) and len({r["media_sha256"] for r in rows if r["doc_id"] in (4, 5)}) == 1
    assert ogg.decode_media(ogg.encode_media(empty)).count() == 0


def test_line_dedup(spark, edge, empty):
    foot = "Copyright 20{} Example Inc and all of its partners"
    docs = spark.createDataFrame([(i, f"word{chr(97 + i)} opens a line that is its own\n{foot.format(10 + i)}\n\nok") for i in range(6)] + [(9, None), (10, "")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in line_dedup.drop_templates(docs).collect()}
    assert out[0]["__n_dropped"] == 0
    assert out[0]["text"].endswith("\n\nok")
    assert all(out[i]["__n_dropped"] == 2 and "Copyright" not in out[i]["text"] and out[i]["text"].endswith("its own\n") for i in range(1, 6))
    kept = line_dedup.drop_templates(docs, min_tokens=3).where("doc_id in (1, 2)").collect()
    assert all(r["__n_dropped"] == 1 and r["text"].endswith("\n\nok") for r in kept)
    assert out[9]["text"] is None and out[9]["__n_lines"] == 0 and out[10]["text"] == "" and out[10]["__n_lines"] == 1
    # A variable field: the leaf's other positions are fixed.
    names = ["Ann", "Bob", "Cy", "Di", "Ed"]
    docs = spark.createDataFrame([(i, f"Posted by user {n} on the main board") for i, n in enumerate(names)], "doc_id long, text string")
    assert line_dedup.drop_templates(docs).where("__n_dropped = 1").count() == 4
    assert line_dedup.drop_templates(edge).count() == len(EDGE) and line_dedup.drop_templates(empty).count() == 0


@pytest.mark.parametrize("other", [100, 300])
def test_line_dedup_finds_templates_that_share_a_leaf(spark, other):
    """Two families of equal length and lead, and one exact line that half of all documents hold."""
    rows = [f"Posted by user n{chr(97 + i // 26)}{chr(97 + i % 26)} on the main board" for i in range(100)]
    rows += [f"Posted by user f{chr(97 + i // 26)}{chr(97 + i % 26)} in our old forum" for i in range(other)]
    rows += ["Posted by user nobody at no known place"] * (100 + other)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    kept = [r["text"] for r in line_dedup.drop_templates(docs).where("__n_dropped = 0").collect()]
    assert sorted(t.split()[-1] for t in kept) == ["board", "forum", "place"]


def plain_templates(docs, min_docs=3, long_tokens=50, percent=70):
    """The template tree in memory, for distinct ids: the texts left, and how many lines went."""
    normal = lambda t: [re.sub("[0-9]+", "0", x).strip(" ") for x in t.replace("\r\n", "\n").split("\n")]
    holders = defaultdict(set)
    for i, t in docs:
        for body in normal(t) if t is not None else []:
            if body:
                holders[body].add(i)
    need = lambda tok: 2 if len(tok) >= long_tokens else min_docs
    leaves = defaultdict(list)
    for body in holders:
        tok = body.split(" ")
        leaves[len(tok), *tok[:3]].append(body)
    template = {}
    for leaf, bodies in leaves.items():
        if len(bodies) < 2 or sum(len(holders[b]) for b in bodies) < need([0] * leaf[0]) or len(set().union(*(holders[b] for b in bodies))) < 2:
            continue
        n, rest = leaf[0], max(leaf[0] - 3, 0)
        differ = n - (n * percent + 99) // 100
        count = 0 if differ >= rest else differ + 1
        keys = {(b, j): (j, tuple(b.split(" ")[3 + j * rest // count : 3 + (j + 1) * rest // count]) if count else ()) for b in bodies for j in range(max(count, 1))}
        for turn in range(line_dedup.ROUNDS):
            by = defaultdict(list)
            for (b, _), key in keys.items():
                by[key].append(b)
            groups = defaultdict(list)
            for b in {b for b, _ in keys}:
                options = [(sum(len(holders[x]) for x in by[key]), -key[0], key) for (c, _), key in keys.items() if c == b and len(by[key]) > 1]
                if options:
                    groups[max(options)[2]].append(b)
            own, barren = {}, set()
            for key, lines in groups.items():
                docs_of = sum(len(holders[b]) for b in lines)
                fixed = {}
                for p in range(n):
                    c = defaultdict(int)
                    for b in lines:
                        c[b.split(" ")[p]] += len(holders[b])
                    top = [x for x, k in c.items() if 2 * k >= docs_of]
                    if len(top) == 1:
                        fixed[p] = top[0]
                hit = [b for b in lines if len(lines) > 1 and all(b.split(" ")[p] == x for p, x in fixed.items()) and 100 * len(fixed) >= percent * n]
                own |= {b: (leaf, key, turn) for b in hit}
                if not hit:
                    barren.add(key)
            template |= own
            keys = {k: v for k, v in keys.items() if k[0] not in own and v not in barren}
    first = {}
    families = defaultdict(set)
    for b, t in template.items():
        families[t] |= {(i, dict(docs)[i]) for i in holders[b]}
    for b, ids in holders.items():
        family = {i for i, _ in families[template[b]]} if b in template else set()
        if b in template and len(family) >= need(b.split(" ")):
            first[b] = min(family)
        elif len(ids) >= need(b.split(" ")):
            first[b] = min(ids)
    out = {}
    for i, t in docs:
        lines = t.split("\n") if t is not None else []
        kept = [x for x, body in zip(lines, normal(t or "")) if first.get(body, i) == i]
        out[i] = (None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_line_dedup_equals_a_tree_in_memory(spark, seed):
    rng = random.Random(seed)
    lines = [" ".join(["a", "b", "c", *(rng.choice("xyzuv") for _ in range(rng.choice((0, 1, 2, 5, 9))))]) for _ in range(120)]
    lines += ["ok", "", "  ", "See page 12", "See page 137\r", "tab\tbed", "no_spaces_here"] + [f"Posted by user n{i} on the main board" for i in range(9)] + [f"Posted by user f{i} in our old forum" for i in range(9)]
    long = [" ".join(f"w{chr(97 + k % 26)}" if k != j else f"own{j}" for k in range(60)) for j in range(4)]
    docs = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 6)))) for i in range(90)] + [(500 + j, x) for j, x in enumerate(long)] + [(600, None), (601, "")]
    got = {r["doc_id"]: (r["text"], r["__n_lines"], r["__n_dropped"]) for r in line_dedup.drop_templates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == plain_templates(docs)


def plain_groups(lines, percent=70):
    """Lines of one leaf and their documents: template by line, from the rounds and from what they leave."""
    tok = {x: x.split(" ") for x in lines}
    n = len(next(iter(tok.values())))
    differ = n - (n * percent + 99) // 100
    count = 0 if differ >= n - 3 else differ + 1
    keys = {(x, j): (j, tuple(t[3 + j * (n - 3) // count : 3 + (j + 1) * (n - 3) // count]) if count else ()) for x, t in tok.items() for j in range(max(count, 1))}
    template = {}

    def shared():
        by = defaultdict(list)
        for (x, _), key in keys.items():
            by[key].append(x)
        return {key: (sum(lines[x] for x in held), held) for key, held in by.items() if len(held) > 1}

    def own(held):
        fixed = {}
        for p in range(n):
            c = defaultdict(int)
            for x in held:
                c[tok[x][p]] += lines[x]
            top = [w for w, k in c.items() if 2 * k >= sum(c.values())]
            if len(top) == 1:
                fixed[p] = top[0]
        enough = len(held) > 1 and 100 * len(fixed) >= percent * n
        return [x for x in held if enough and all(tok[x][p] == w for p, w in fixed.items())]

    turn = 0
    while groups := shared():
        options = defaultdict(list)
        for key, (docs, held) in groups.items():
            for x in held if turn < line_dedup.ROUNDS else own(held):
                options[x].append((docs, -key[0], key))
        chosen = defaultdict(list)
        for x, found in options.items():
            chosen[max(found)[2]].append(x)
        if turn < line_dedup.ROUNDS:
            hits = {key: own(held) for key, held in chosen.items()}
            barren = {key for key, hit in hits.items() if not hit}
        else:
            hits = chosen
            barren = {key for key, (_, held) in groups.items() if not own(held)}
        taken = {x: (turn, key) for key, hit in hits.items() for x in hit}
        template |= taken
        keys = {k: key for k, key in keys.items() if k[0] not in taken and key not in barren}
        turn += 1
    return template, turn


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_line_dedup_groups_all_that_the_rounds_leave(spark, seed):
    rng = random.Random(seed)
    lines = {}
    for _ in range(40):
        base = [rng.choice("pqrs") for _ in range(37)]
        for _ in range(rng.randint(1, 5)):
            x = [rng.choice("xyzuvw") if rng.random() < 0.15 else w for w in base]
            # Blocks of other lines: lines share them without being akin.
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(34)
                x[at : at + 3] = list("tmn")
            lines[" ".join(["a", "b", "c", *x])] = rng.randint(1, 3)
    expected, turns = plain_groups(lines)
    assert turns > line_dedup.ROUNDS and any(turn >= line_dedup.ROUNDS for turn, _ in expected.values())
    told = spark.createDataFrame([(7, i, k, x) for i, (x, k) in enumerate(lines.items())], "leaf long, body long, n long, line string")
    got = {r["body"]: r["template"] for r in line_dedup._templates(told, 70).collect()}
    families = defaultdict(set)
    for body, template in got.items():
        families[template].add(body)
    plain = defaultdict(set)
    for i, x in enumerate(lines):
        if x in expected:
            plain[expected[x]].add(i)
    assert sorted(map(sorted, families.values())) == sorted(map(sorted, plain.values()))


def test_long_lines_recur_in_two_documents(spark):
    long = " ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(50))
    docs = spark.createDataFrame([(1, long), (2, f"own\n{long}"), (3, "a short line twice"), (4, "a short line twice"), (5, f"{long[:-3]}end")], "doc_id long, text string")
    out = {r["doc_id"]: r["__n_dropped"] for r in line_dedup.drop_templates(docs.where("doc_id < 5")).collect()}
    assert out == {1: 0, 2: 1, 3: 0, 4: 0}
    # Two long lines that are akin.
    assert line_dedup.drop_templates(docs.where("doc_id in (1, 5)")).where("__n_dropped = 1").count() == 1


def test_new_words_are_encoded_together():
    path = tokens.default_tokenizer()
    enc = tokens.Encoder(path)
    plain, calls = enc.tokenizer, []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            calls.append(list(texts))
            return plain.encode_batch_fast(texts, **options)

        def encode(self, text, **options):
            return plain.encode(text, **options)

    enc.tokenizer = Counted()
    texts = ["Alpha\nBeta\nzweiundvierzig Wörter", "(Gamma) Слово\nслово", "漢字\nかな x"]
    for _ in range(2):
        assert enc(texts) == [np.array(plain.encode(t, add_special_tokens=False).ids, dtype=enc.dtype).tobytes() for t in texts]
    # Words of letters in one call, those after a space in another; the rest one by one.
    assert sorted(len(c) for c in calls if c) == [1, 1, 3] and sorted(max(calls, key=len)) == ["\n", "(", ")"]


def test_ids_equal_the_plain_call():
    from tokenizers import Tokenizer

    path = tokens.default_tokenizer()
    plain = Tokenizer.from_file(path)
    enc = tokens.Encoder(path)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "a b", "a <|endof text|>  b", " <|endoftext|><|endoftext|>\n x", ""]
    for text, data in zip(texts, enc(texts), strict=True):
        assert np.frombuffer(data, dtype=enc.dtype).tolist() == plain.encode(text, add_special_tokens=False).ids
    assert 50256 in np.frombuffer(enc([texts[0]])[0], dtype=enc.dtype)


def test_ids_equal_the_library_on_all_texts(spark):
    """Every text of sf0.01, and generated ones of all kinds of characters."""
    from tokenizers import Tokenizer

    path = tokens.default_tokenizer()
    plain = Tokenizer.from_file(path)
    enc = tokens.Encoder(path)
    rng = random.Random(12)
    ranges = [(9, 14), (32, 127), (32, 127), (128, 0x250), (0x300, 0x370), (0x370, 0x530), (0x590, 0x700), (0x900, 0xA00), (0x2000, 0x2070), (0x2070, 0x2100), (0x2150, 0x2190), (0x3000, 0x3100), (0x4E00, 0x4E80), (0xAC00, 0xAC40), (0xFE00, 0x10000), (0x1F300, 0x1F700)]

    def char():
        low, high = rng.choice(ranges)
        return chr(rng.randrange(low, high))

    made = ["".join(char() if rng.random() < 0.4 else rng.choice([" ", "  ", "a", "the", "'s", "'ll", "1", "23", "\n", "\t", ".", "_", "é"]) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()] + made
    want = plain.encode_batch(texts, add_special_tokens=False)
    for k in range(0, len(texts), 256):
        for data, e in zip(enc(texts[k : k + 256]), want[k : k + 256], strict=True):
            assert np.frombuffer(data, dtype=enc.dtype).tolist() == e.ids


@pytest.mark.parametrize("bits", [1, 5, 8, 16, 17, 32])
def test_bit_packing(bits, tmp_path):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 1 << bits, 1001).astype(np.uint32)
    assert (tokens.unpack(tokens.pack(ids, bits), len(ids), bits) == ids).all()
    path = tmp_path / "x.ids"
    path.write_bytes(b"".join(tokens.packed_file(ids, bits, 100)))
    f = tokens.PackedIds(f"file://{path}")
    for start, n in ((0, 1001), (99, 2), (250, 0), (1000, 1), (100, 100)):
        assert (f.read(start, n) == ids[start : start + n]).all()


def test_token_files(spark, edge, empty, monkeypatch):
    monkeypatch.setattr(tokens, "FILE_IDS", 8)
    folder, index = tokens.write_ids(edge.where("doc_id <> 8"), tokens.default_tokenizer(), folder=shared_dir(spark, "t"))
    rows = sorted((tuple(r) for r in tokens.read_ids(folder, index).collect()), key=lambda r: r[1])
    at = 0
    for (doc, start, n, _) in rows:
        assert start == at
        at += n
    want = {(i, zlib.crc32(np.array([*ids, 0], dtype="<u4").tobytes())) for (i, _), ids in zip(EDGE, encoded([t for _, t in EDGE]), strict=True) if i not in (8, None)}
    assert want == {(r[0], r[3]) for r in rows}
    folder, index = tokens.write_ids(empty, tokens.default_tokenizer())
    assert tokens.read_ids(folder, index).count() == 0


def test_names_of_other_columns_do_no_harm(spark):
    names = ["doc", "content", "row", "text_a", "__doc", "__id", "__raw", "__fit", "__text", "__row", "__label_id", "bodies", "__url", "node", "part"]
    docs = spark.createDataFrame([(i, f"line {i}\nshared words of all the documents here", *[f"{n}{i}" for n in names]) for i in range(6)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(6)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "shared words of all")], "item_id long, text string")
    outs = [line_dedup.drop_templates(docs), quality.importance_sample(docs, labels), ngram_join.one_of_each_class(docs), fm_index.contamination(docs, bench, cut=True), urls.filter_urls(docs, urls.contract_rules(spark), urls.default_list(spark), "text")]
    for out in outs:
        rows = out.collect()
        assert rows and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names)
    counts = [sharding.assign_shards(docs, 2), ngram_join.similar_classes(docs), packing.pack_documents(docs, tokens.default_tokenizer()), ogg.decode_media(ogg.encode_media(docs))]
    assert all(out.count() == 6 for out in counts)


def test_pipeline_stages_equal_plain_ones(spark):
    """Line dedup, packing and the whole run, over sf0.001."""
    import corpus_pipeline as P
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    plain = {i: t for i, (t, _, dropped) in plain_templates(rows).items() if not dropped or t.strip()}
    assert {r["doc_id"]: r["text"] for r in P.line_dedup(spark, docs, sf).collect()} == plain
    cut = P.line_dedup(spark, docs, sf).where("n_chars <> length(text)").count()
    assert cut == docs.where("n_chars <> length(text)").count()
    chain = docs
    for name, stage in P.STAGES[:-1]:
        chain = stage(spark, chain, sf)
        assert chain.columns == docs.columns
        chain = spark.createDataFrame(chain.collect(), docs.schema)
    encoder = Tokenizer.from_file(tokens.default_tokenizer())
    want = {}
    for r in chain.collect():
        ids = [*encoder.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        at, n = 0, len(ids)
        for piece in range(-(-n // 1024)):
            length = (n % 1024 or 1024) if piece == 0 else 1024
            want[r["doc_id"], piece] = (at, length, zlib.crc32(np.array(ids[at : at + length], dtype="<u4").tobytes()))
            at += length
    got = P.run(spark, sf).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    # A text of blanks that a cut leaves goes; one that was so stays as it is.
    some = spark.createDataFrame([(i, "the same long line of words stands here\n", "en", "s", 40) for i in range(4)] + [(9, "\n", "en", "s", 1)], docs.schema)
    assert sorted(r["doc_id"] for r in P.line_dedup(spark, some, sf).collect()) == [0, 9]


def test_pipeline(spark):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(P.STAGES) == 5
    cols = docs.columns
    first = P.quality(spark, docs, sf)
    assert first.columns == cols and first.count() < docs.count()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = P.decontaminate(spark, docs, sf)
    assert clean.columns == cols
    left = [(r["doc_id"], r["text"]) for r in clean.collect()]
    before = brute_hits([(r["doc_id"], r["text"]) for r in docs.collect()], items)
    kept = {d for d, (_, hit, _) in before.items() if not hit}
    assert kept <= {d for d, _ in left}
    one = P.near_duplicates(spark, docs, sf)
    classes = brute_classes([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {r["doc_id"] for r in one.collect()} == {d for d, (_, c) in classes.items() if c == d}
