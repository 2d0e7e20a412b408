"""Line deduplication by a log-template tree, with DataFrame functions only.

A line is parsed by a tree of fixed depth: first by its number of tokens, then by its three leading
tokens, then by a block of its other tokens. Digits are variable from the start (a run of them reads
as 0), and a carriage return before a line feed is none of the line. A leaf of the second level holds one line or several. Several
are parted by blocks: of ``n`` tokens, lines of one template differ in at most ``n - similarity * n``,
so with one block more than that they agree on a block as a whole. A line goes to that block of its own
which most documents share (then to the first of them). Of a group so found, the positions where one
token alone holds at least half of the documents are fixed, the others variable; if at least ``similarity``
of the positions are fixed, they are a template, and the lines that agree with it are its own. Lines
left over are grouped again, :data:`ROUNDS` times in all, without the blocks that gave no template. After
that, every block that several lines still share is a group of all its lines, and a line goes to that of
the templates it agrees with which most documents share (then to the first block's); this is repeated with
the lines left over, without the blocks that gave no template, until no block is left. :data:`OP9_SQL`
states the first :data:`ROUNDS` groupings only; the tests hold the rest to a tree in memory.

A template that recurs in ``min_docs`` documents or more, or in two if its lines have ``long_tokens``
tokens, is dropped, but for its occurrences in the document with the smallest id; so is a line that
recurs as it is. Blank lines and lines of fewer than ``min_tokens`` tokens stay.

What is shuffled are hashes: a row per distinct line of a document, combined on the map side into a
count and a smallest id per line, so that a line in a third of all documents is one row a task.
Tokens are compared only for leaves that hold several different lines and enough documents; each
such line gives a row per block and, in a round, a row per token, never a row per pair. After the rounds it
gives a row per token for each block left, blocks shared by the same lines being one.

Defined cases: a null text stays null and has no lines; an empty text is one blank line; repeated
rows (equal id and text) are one document; a null id is a document of its own class for each text, which
is never the first where another holds the line; a text whose lines all go is empty; an empty table gives
an empty result; other columns are kept, but for ``__n_lines`` and ``__n_dropped``, which are replaced.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, discard, packed, written

LEADING = 3
#: Times that the lines of a leaf which have no template yet are grouped by their best blocks.
ROUNDS = 3


def _normal(text: Column) -> Column:
    """The text with every run of digits as one 0, and lines that end in a line feed alone."""
    return F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), "[0-9]+", "0")


def _body(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def _gone(text: Column, bodies: Column) -> Column:
    """For each line whether its hash is among ``bodies``."""
    return F.transform(F.split(_normal(text), "\n", -1), lambda line: F.array_contains(bodies, _body(line)))


def _small(df: DataFrame, bytes_a_row: int) -> DataFrame:
    """Marked for broadcast if its counted rows are within the bound."""
    return F.broadcast(df) if df.count() * bytes_a_row <= BROADCAST_BYTES else df


def _blocks(told: DataFrame, percent: int) -> DataFrame:
    """``body, n, j, key``: the blocks of each line's tokens after the leading ones."""
    parts = F.split("line", " ")
    rows = told.select("leaf", "body", "n", parts.alias("parts"), F.size(parts).alias("size"))
    differ = F.expr(f"size - (size * {percent} + 99) div 100").cast("int")
    rest = F.greatest(F.col("size") - LEADING, F.lit(0))
    # Lines that may differ in all the rest are parted by no block.
    rows = rows.withColumns({"rest": rest, "blocks": F.when(differ >= rest, 0).otherwise(differ + 1).cast("int")})
    at = lambda j: F.expr("rest") * j / F.greatest("blocks", F.lit(1))
    start = lambda j: F.floor(at(j)).cast("int")
    block = lambda j: F.slice("parts", start(j) + LEADING + 1, F.when(F.col("blocks") == 0, 0).otherwise(start(j + 1) - start(j)))
    last = F.greatest(F.col("blocks") - 1, F.lit(0))
    return rows.select("body", "n", F.posexplode(F.transform(F.sequence(F.lit(0), last), lambda j: F.xxhash64("leaf", j, block(j)))).alias("j", "key"))


def _own(grouped: DataFrame, percent: int) -> DataFrame:
    """``leaf, body, key, docs, j`` of the lines that agree with the template of their group."""
    # Tokens go as hashes, and a group's documents with them, so that token rows are shuffled once.
    tokens = grouped.select("key", "docs", "n", F.posexplode(F.split("line", " ")).alias("pos", "token")).withColumn("token", F.xxhash64("token"))
    common = tokens.groupBy("key", "docs", "pos", "token").agg(F.sum("n").alias("n")).where("2 * n >= docs")
    # Two tokens may hold half each: the position is then variable.
    fixed = common.groupBy("key", "pos").agg(F.count(F.lit(1)).alias("c"), F.min("token").alias("token")).where("c = 1")
    pattern = fixed.groupBy("key").agg(F.collect_list(F.struct("pos", "token")).alias("pattern"))
    agrees = F.forall("pattern", lambda p: F.xxhash64(F.get(F.col("parts"), p["pos"])) == p["token"])
    enough = F.size("pattern") * 100 >= F.size("parts") * percent
    return grouped.withColumn("parts", F.split("line", " ")).join(pattern, "key").where(enough).where(agrees).select("leaf", "body", "key", "docs", "j")


def _templates(told: DataFrame, percent: int) -> DataFrame:
    """``leaf, body, template`` of the lines that have a template."""
    keys = written(_blocks(told, percent), "blocks")
    spare = [keys]
    found = None
    lines = told.select("leaf", "body", "line")
    for turn in range(ROUNDS):
        shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("lines"), F.sum("n").alias("docs")).where("lines > 1")
        best = keys.join(shared, "key").groupBy("body").agg(F.first("n").alias("n"), F.max(F.struct("docs", (-F.col("j")).alias("first"), "key")).alias("best"))
        best = written(best.select("body", "n", F.col("best.key").alias("key"), (-F.col("best.first")).alias("j")), "best")
        totals = best.groupBy("key").agg(F.sum("n").alias("docs"), F.count(F.lit(1)).alias("lines")).where("lines > 1").drop("lines")
        grouped = written(lines.join(best.join(totals, "key"), "body"), "grouped")
        own = written(_own(grouped, percent).withColumn("template", F.xxhash64("key", F.lit(turn))), "own")
        found = own if found is None else found.unionByName(own)
        spare += [best, grouped, own]
        barren = best.select("key").distinct().join(own.select("key").distinct(), "key", "left_anti")
        keys = written(keys.join(own.select("body"), "body", "left_anti").join(barren, "key", "left_anti"), "blocks")
        spare.append(keys)
        if keys.isEmpty():
            break
    # What is left: all blocks at once, those of equal lines as one, until none is left.
    same = ["lines", "docs", "a", "b"]
    for turn in itertools.count(ROUNDS):
        marks = [F.bit_xor(F.xxhash64("body", F.lit(i))).alias(name) for i, name in enumerate("ab")]
        sets = written(keys.groupBy("key", "j").agg(F.count(F.lit(1)).alias("lines"), F.sum("n").alias("docs"), *marks).where("lines > 1"), "sets")
        spare.append(sets)
        if sets.isEmpty():
            break
        ones = sets.groupBy(*same).agg(F.min(F.struct("j", "key")).alias("one"))
        grouped = written(lines.join(keys.join(ones.select(F.col("one.key").alias("key"), "docs"), "key"), "body"), "grouped")
        tried = written(_own(grouped, percent), "tried")
        best = tried.groupBy("leaf", "body").agg(F.max(F.struct("docs", (-F.col("j")).alias("first"), "key")).alias("best"))
        own = written(best.select("leaf", "body", F.col("best.key").alias("key"), F.xxhash64("best.key", F.lit(turn)).alias("template")), "own")
        found = found.select(*own.columns).unionByName(own)
        spare += [grouped, tried, own]
        if own.isEmpty():
            break
        fertile = sets.join(ones, same).join(tried.select(F.col("key").alias("of")).distinct(), F.col("one.key") == F.col("of")).select(sets["key"])
        keys = written(keys.join(own.select("body"), "body", "left_anti").join(fertile, "key", "left_semi"), "blocks")
        spare.append(keys)
    members = written(found.select("leaf", "body", "template"), "members")
    discard(*spare)
    return members


def drop_templates(docs: DataFrame, min_docs: int = 3, min_tokens: int = 1, similarity: float = 0.7, long_tokens: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row, its text without recurring templates, with ``__n_lines`` and ``__n_dropped``."""
    if min_docs < 2:
        raise ValueError("min_docs must be at least 2")
    # The input's columns are packed, so that their names meet no others.
    kept_columns = [c for c in docs.columns if c not in ("__n_lines", "__n_dropped")]
    key = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))
    rows = docs.select(packed(kept_columns, text_col).alias("row"), key.alias("doc"), F.xxhash64(F.col(text_col)).alias("content"), F.col(text_col).alias("text"))
    texts = rows.drop("row")

    def parsed(rows: DataFrame) -> DataFrame:
        """Lines are exploded first and parsed after, by generated code."""
        lines = rows.where(F.col("text").isNotNull()).select("doc", "content", F.explode(F.split(_normal(F.col("text")), "\n", -1)).alias("line"))
        lines = lines.select("doc", "content", F.trim("line").alias("line"))
        spaces = F.octet_length("line") - F.octet_length(F.replace(F.col("line"), F.lit(" "), F.lit("")))
        lines = lines.where("line <> ''").withColumn("spaces", spaces).where(F.col("spaces") >= min_tokens - 1)
        need = F.when(F.col("spaces") >= long_tokens - 1, 2).otherwise(min_docs)
        return lines.select("doc", "content", F.xxhash64("spaces", F.substring_index("line", " ", LEADING)).alias("leaf"), F.xxhash64("line").alias("body"), "line", need.alias("need"))

    lines = parsed(texts)
    thin = written(lines.select("doc", "content", "leaf", "body", "need").distinct(), "thin")
    bodies = written(thin.groupBy("leaf", "body").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("first"), F.max("doc").alias("last"), F.first("need").alias("need")), "lines")
    leaves = bodies.groupBy("leaf").agg(F.first("need").alias("need"), F.count(F.lit(1)).alias("bodies"), F.sum("n").alias("leaf_n"), F.min("first").alias("lo"), F.max("last").alias("hi"))
    leaves = written(leaves.where("bodies > 1 and leaf_n >= need and lo <> hi").select("leaf", "leaf_n"), "leaves")
    some = _small(leaves, 32)

    # The lines of the leaves that hold different ones. Each line's text is told once, by the
    # documents where it comes first, so that only they are read again.
    wanted = written(bodies.join(some.select("leaf"), "leaf").select(F.col("first").alias("doc"), "leaf", "body", "n"), "wanted")
    readers = wanted.select("doc").distinct()
    few = readers.count() * 16 <= BROADCAST_BYTES
    again = texts.join(F.broadcast(readers), "doc", "left_semi") if few else texts
    told = parsed(again).select("doc", "leaf", "body", "line").join(_small(wanted, 64), ["doc", "leaf", "body"])
    told = written(told.groupBy("leaf", "body").agg(F.first("n").alias("n"), F.first("line").alias("line")), "told")
    members = _templates(told, round(100 * similarity))
    # A document with two lines of one template counts once.
    of_template = thin.join(_small(members, 32), ["leaf", "body"])
    groups = of_template.select("template", "doc", "content", "need").distinct().groupBy("template", "need").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("first"), F.max("doc").alias("last"))
    # Of one document's repeated lines, as of a line that only one document has, nothing is dropped.
    by_template = members.join(groups.where("n >= need and first <> last"), "template").select("leaf", "body", "first")
    alone = bodies.where("n >= need and first <> last").select("leaf", "body", "first")
    recurring = written(alone.join(by_template.select("leaf", "body"), ["leaf", "body"], "left_anti").unionByName(by_template), "recurring")

    drops = thin.join(_small(recurring, 48), ["leaf", "body"]).where("doc <> first")
    drops = drops.groupBy("doc", "content").agg(F.collect_set("body").alias("bodies"))
    out = rows.join(drops, ["doc", "content"], "left")
    text = F.col("text")
    hit = F.col("bodies").isNotNull()
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n", -1)))
    out = out.withColumns({"gone": F.when(hit, _gone(text, F.col("bodies"))), "n_lines": n_lines.cast("long")})
    n_dropped = F.when(hit, F.size(F.filter("gone", lambda g: g))).otherwise(0).cast("long")
    # Joining leaves the nulls out.
    kept = F.zip_with(F.split(text, "\n", -1), "gone", lambda line, g: F.when(~g, line))
    cut = F.when(hit, F.array_join(kept, "\n")).otherwise(text)
    return out.select(*[cut.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in kept_columns], F.col("n_lines").alias("__n_lines"), n_dropped.alias("__n_dropped"))


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without the lines of recurring templates: counts, and the digest of what stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = drop_templates(docs)
    kept = F.coalesce("text", F.lit(""))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.octet_length(kept).cast("long").alias("kept_bytes"), F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


def _round_sql(k: int) -> str:
    """One grouping of the lines of ``k{k}`` (body, n, j, key): its members ``m{k}``, and what is left as ``k{k + 1}``."""
    return f"""
s{k} AS (SELECT key, sum(n) AS docs FROM k{k} GROUP BY 1 HAVING count(*) > 1),
c{k} AS (SELECT body, arg_max(key, docs * 100000 - j) AS key FROM k{k} JOIN s{k} USING (key) GROUP BY 1),
g{k} AS (SELECT b.*, c{k}.key FROM b JOIN c{k} USING (body)),
w{k} AS (SELECT key, sum(n) AS docs FROM g{k} GROUP BY 1 HAVING count(*) > 1),
t{k} AS (SELECT key, n, unnest(tok) AS token, generate_subscripts(tok, 1) AS p FROM g{k}),
f{k} AS (
  SELECT key, p, min(token) AS token FROM (SELECT key, p, token FROM t{k} JOIN w{k} USING (key) GROUP BY key, p, token, docs HAVING 2 * sum(n) >= docs)
  GROUP BY 1, 2 HAVING count(*) = 1),
m{k} AS (
  SELECT g{k}.leaf, g{k}.body, g{k}.key, '{k}:' || g{k}.key AS template FROM g{k} JOIN f{k} USING (key)
  GROUP BY ALL HAVING count(*) = count(*) FILTER (WHERE g{k}.tok[f{k}.p] = f{k}.token) AND count(*) * 100 >= any_value(len(g{k}.tok)) * 70),
k{k + 1} AS (
  SELECT * FROM k{k} WHERE body NOT IN (SELECT body FROM m{k}) AND key NOT IN (SELECT key FROM g{k} WHERE key NOT IN (SELECT key FROM m{k}))),"""


# Written for documents with distinct ids and no null ones.
OP9_SQL = """
WITH raw AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS own,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL),
l AS (
  SELECT doc_id, text, pos, line, trim(regexp_replace(own, '[0-9]+', '0', 'g'), ' ') AS body FROM raw),
d AS (
  SELECT DISTINCT doc_id, text, body, string_split(body, ' ') AS tok FROM l WHERE body <> ''),
a AS (
  SELECT any_value(concat_ws(' ', CAST(len(tok) AS VARCHAR), array_to_string(tok[1:3], ' '))) AS leaf, body, any_value(tok) AS tok,
         count(*) AS n, min(doc_id) AS first, CASE WHEN any_value(len(tok)) >= 50 THEN 2 ELSE 3 END AS need FROM d GROUP BY body),
lf AS (SELECT leaf FROM a JOIN d USING (body) GROUP BY leaf, need HAVING count(DISTINCT body) > 1 AND count(*) >= need AND count(DISTINCT doc_id) > 1),
b AS (SELECT leaf, body, tok, n, greatest(len(tok) - 3, 0) AS rest, len(tok) - (len(tok) * 70 + 99) // 100 AS differ FROM a SEMI JOIN lf USING (leaf)),
bb AS (SELECT *, CASE WHEN differ >= rest THEN 0 ELSE differ + 1 END AS blocks FROM b),
bj AS (SELECT *, unnest(range(0, greatest(blocks, 1))) AS j FROM bb),
k0 AS (
  SELECT body, n, j, concat_ws(chr(1), leaf, CAST(j AS VARCHAR), CASE WHEN blocks > 0 THEN array_to_string(tok[j * rest // blocks + 4:(j + 1) * rest // blocks + 3], ' ') END) AS key
  FROM bj),""" + "".join(map(_round_sql, range(ROUNDS))) + f"""
mb AS ({" UNION ALL ".join(f"SELECT leaf, body, template FROM m{k}" for k in range(ROUNDS))}),
gr AS (
  SELECT template, min(doc_id) AS first FROM (SELECT DISTINCT template, doc_id, text, need FROM d JOIN mb USING (body) JOIN a USING (body))
  GROUP BY template, need HAVING count(*) >= need AND count(DISTINCT doc_id) > 1),
bl AS (SELECT mb.body, gr.first FROM mb JOIN gr USING (template)),
rc AS (
  SELECT * FROM bl
  UNION ALL
  SELECT body, first FROM a WHERE body NOT IN (SELECT body FROM bl) AND n >= need AND n > 1),
dr AS (SELECT d.doc_id, d.body FROM d JOIN rc USING (body) WHERE d.doc_id <> rc.first),
j AS (
  SELECT l.doc_id, l.pos, l.line, dr.body IS NOT NULL AS gone
  FROM l LEFT JOIN dr ON l.doc_id = dr.doc_id AND l.body = dr.body),
k AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept
  FROM j GROUP BY doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped,
       CAST(octet_length(encode(coalesce(k.kept, ''))) AS BIGINT) AS kept_bytes, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN k USING (doc_id)
"""
