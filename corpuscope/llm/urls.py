"""URL filter: a blocked Bloom filter of listed canonical URLs before an exact hash join.

A listed entry is a canonical URL key ``host + path`` (``example.com/en/``) with a verdict. It fits
its host and all subdomains, if the URL's path starts with the entry's path; rules come before the
list, then the longest host, then the longest path wins, then ``block``. The keys a URL can hit are its host's suffixes joined with its path's prefixes
of the lengths that occur in the list.

The filter is built by a distributed aggregation: a key sets eight bits in one block of eight
32-bit words. Its bytes follow from the number of listed keys, so the broadcast is decided by a
checked size; a larger filter stays distributed and is probed by a shuffle join on the block.
Keys that pass are possible hits; an exact join with the list removes the false positives
(:func:`filter_report` counts them). Probing works on distinct URLs, so that a hot URL is probed once;
of a host, no more labels are looked at than the list's longest host has.

Defined cases: a null URL, or one without ``://``, has an empty host and path and fits no entry;
repeated rows stay; null list entries are ignored; an empty list fits nothing; an empty table gives
an empty result. Columns of the input are passed through; those named ``__host``, ``__path``,
``__entry`` or ``__verdict`` are replaced by the added ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, packed

#: Keys a block of 256 bits takes on average: 16 bits a key.
KEYS_A_BLOCK = 16
BLOCK_BYTES = 48

# The contract's rules: fixed values.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: A sample of a block list, as canonical URLs: whole hosts, and parts of hosts. A real list is a
#: table, given as ``listed`` (see :func:`listed_entries`).
LISTED = (
    "http://ads-track.example.org/",
    "http://adult-x.example.org/",
    "http://casino-win.example.org/",
    "http://cheap-pills.example.org/",
    "http://free-bets.example.org/",
    "http://spam-farm.example.org/",
    "http://mirror.example.org/cracked/",
)


def _rest(url: Column) -> Column:
    return F.substr(url, F.instr(url, "://") + F.lit(3))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.when(url.contains("://"), F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise("")


def path_of(url: Column) -> Column:
    """After the host, up to ``?``, ``#`` or the end."""
    return F.when(url.contains("://"), F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def _bits(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key, and the mask it sets in each of the block's eight words."""
    block = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("long")
    places = F.xxhash64(key, F.lit(1))
    bits = [F.shiftrightunsigned(places, 5 * i).bitwiseAND(F.lit(31)).cast("int") for i in range(8)]
    return block, [F.call_function("shiftleft", F.lit(1).cast("long"), b) for b in bits]


def build_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """``__block, __w0 .. __w7`` of the keys in column ``__key``; combines on the map side."""
    block, masks = _bits(F.col("__key"), blocks)
    return keys.select(block.alias("__block"), *[m.alias(f"__w{i}") for i, m in enumerate(masks)]).groupBy("__block").agg(*[F.bit_or(f"__w{i}").alias(f"__w{i}") for i in range(8)])


def possible_hits(candidates: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """The candidates whose eight bits are all set."""
    block, masks = _bits(F.col("__key"), blocks)
    small = blocks * BLOCK_BYTES * 2 <= BROADCAST_BYTES
    probed = candidates.withColumn("__block", block).join(F.broadcast(bloom) if small else bloom, "__block")
    hit = None
    for i, m in enumerate(masks):
        bit = F.col(f"__w{i}").bitwiseAND(m) != 0
        hit = bit if hit is None else hit & bit
    return probed.where(hit).select(*candidates.columns)


def _listed(entries: DataFrame) -> DataFrame:
    listed = entries.where(F.col("host").isNotNull() & F.col("path").isNotNull()).select(F.concat("host", "path").alias("__key"), F.length("host").alias("__hl"), F.length("path").alias("__pl"), F.size(F.split("host", r"\.")).alias("__labels"), F.col("verdict").alias("__verdict"))
    # One entry a key: block wins over allow.
    return listed.groupBy("__key", "__hl", "__pl").agg(F.max("__verdict").alias("__v"), F.max("__labels").alias("__labels"))


def _candidates(pages: DataFrame, url_col: str, lengths: list[int], labels: int) -> DataFrame:
    """``__url, __key, __hl, __pl``: the keys that the distinct URLs could hit."""
    urls = pages.select(F.col(url_col).alias("__url")).where(F.col("__url").isNotNull()).distinct()
    urls = urls.select("__url", host_of(F.col("__url")).alias("__host"), path_of(F.col("__url")).alias("__path")).where(F.col("__host") != "")
    # Longer suffixes than the list has cannot fit.
    suffixes = F.array(*[F.substring_index("__host", ".", -i) for i in range(1, max(1, labels) + 1)])
    prefixes = F.array(*[F.substring("__path", 1, int(k)) for k in sorted(lengths)]) if lengths else F.array(F.lit(""))
    cand = urls.select("__url", F.explode(F.array_distinct(suffixes)).alias("__s"), F.array_distinct(prefixes).alias("__ps")).select("__url", F.explode("__ps").alias("__p"), "__s")
    return cand.select("__url", F.concat("__s", "__p").alias("__key"), F.length("__s").alias("__hl"), F.length("__p").alias("__pl"))


def _probed(pages: DataFrame, entries: DataFrame, url_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The candidates, those of them that the filter lets pass, and those that are listed."""
    listed = _listed(entries)
    n, lengths, labels = listed.agg(F.count(F.lit(1)), F.collect_set("__pl"), F.max("__labels")).first()
    blocks = max(1, -(-n // KEYS_A_BLOCK))
    bloom = build_filter(listed.select("__key"), blocks)
    cand = _candidates(pages, url_col, lengths, labels or 1)
    passed = possible_hits(cand, bloom, blocks)
    return cand, passed, passed.join(listed, ["__key", "__hl", "__pl"])


def filter_report(pages: DataFrame, entries: DataFrame, url_col: str = "url") -> DataFrame:
    """One row: keys probed, possible hits, and the false positives that the exact join removed."""
    cand, passed, hits = _probed(pages, entries, url_col)
    counts = [df.select(F.lit(name).alias("what")) for name, df in (("probed", cand), ("possible", passed), ("listed", hits))]
    told = counts[0].unionByName(counts[1]).unionByName(counts[2]).agg(*[F.sum((F.col("what") == w).cast("long")).alias(w) for w in ("probed", "possible", "listed")])
    return told.withColumn("false_positives", F.col("possible") - F.col("listed")).fillna(0)


def listed_entries(listed: DataFrame, url_col: str = "url") -> DataFrame:
    """``host, path, verdict`` of a table of canonical URLs to block; a URL without a path lists its host."""
    path = path_of(F.col(url_col))
    return listed.select(host_of(F.col(url_col)).alias("host"), F.when(path == "", "/").otherwise(path).alias("path"), F.lit("block").alias("verdict")).where("host <> ''")


def contract_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULES), "host string, path string, verdict string")


def default_list(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(u,) for u in LISTED], "url string")


def filter_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with ``__host``, ``__path``, ``__entry`` (the rule that fits, or null) and ``__verdict``.

    Rules come first; where none fits, the list blocks, and what it does not hold is allowed. Both
    go through one filter: a listed key is told from a rule by its verdict's mark.
    """
    marked = rules.withColumn("verdict", F.concat(F.lit("rule:"), "verdict")).unionByName(listed_entries(listed).withColumn("verdict", F.concat(F.lit("list:"), "verdict")))
    _, _, hits = _probed(pages, marked, url_col)
    # A key that a rule and the list share is the rule's: "rule:" is the larger mark.
    best = F.max(F.struct(F.col("__v").startswith("rule:").alias("r"), "__hl", "__pl", F.col("__v").alias("v"), F.col("__key").alias("k"))).alias("__best")
    verdicts = hits.groupBy("__url").agg(best).select("__url", F.when(F.col("__best.r"), F.col("__best.k")).alias("__entry"), F.substr(F.col("__best.v"), F.lit(6)).alias("__verdict"))
    # URLs without a host meet nothing, so that they need no place in the join.
    columns = [c for c in pages.columns if c not in ("__host", "__path", "__entry", "__verdict")]
    url = F.col(url_col)
    rows = pages.select(packed(columns, url_col).alias("row"), url.alias("__url"), F.coalesce(host_of(url), F.lit("")).alias("__host"), F.coalesce(path_of(url), F.lit("")).alias("__path"))
    met = rows.where("__host <> ''").join(verdicts, "__url", "left").withColumn("__verdict", F.coalesce("__verdict", F.lit("allow")))
    none = {"__entry": F.lit(None).cast("string"), "__verdict": F.lit("allow")}
    out = met.unionByName(rows.where("__host = ''").withColumns(none))
    return out.select(*[(F.col("__url") if c == url_col else F.col("row")[c]).alias(c) for c in columns], "__host", "__path", "__entry", "__verdict")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict: of the longest rule that fits, else of the list (not listed: allow)."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    judged = filter_urls(pages, contract_rules(spark), default_list(spark))
    return judged.select("page_id", F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__entry").alias("rule"), F.col("__verdict").alias("verdict"))


OP2_SQL = r"""
WITH p AS (
  SELECT page_id, url, strpos(url, '://') AS at,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM p),
rules(rhost, rpath, verdict, is_rule) AS (VALUES
  ('com', '/', 'allow', true), ('example.com', '/en/', 'block', true), ('www.example.com', '/en/', 'allow', true),
  ('net', '/es/', 'block', true), ('net', '/fr/', 'block', true),
  ('ads-track.example.org', '/', 'block', false), ('adult-x.example.org', '/', 'block', false),
  ('casino-win.example.org', '/', 'block', false), ('cheap-pills.example.org', '/', 'block', false),
  ('free-bets.example.org', '/', 'block', false), ('spam-farm.example.org', '/', 'block', false),
  ('mirror.example.org', '/cracked/', 'block', false)),
m AS (
  SELECT h.*, r.rhost, r.rpath, r.verdict, r.is_rule,
         row_number() OVER (PARTITION BY h.page_id, h.host, h.path ORDER BY coalesce(r.is_rule, false) DESC, length(r.rhost) DESC NULLS LAST, length(r.rpath) DESC) AS k
  FROM h LEFT JOIN rules r ON (h.host = r.rhost OR ends_with(h.host, '.' || r.rhost)) AND starts_with(h.path, r.rpath))
SELECT page_id, host, path, CASE WHEN is_rule THEN rhost || rpath END AS rule, coalesce(verdict, 'allow') AS verdict
FROM m WHERE k = 1
"""
