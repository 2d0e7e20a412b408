"""Readers and writers of corpora.

Every reader gives doc_id, text, source, label (nullable strings) and meta (a map), so that plans do
not depend on the input's shape. Numeric ids of tables are kept as they are by ``from_table``. Paths may
lie in any store that Spark reads, and may hold globs.
"""

from __future__ import annotations

import json
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType
from pyspark.sql.window import Window

from ..constants import ID_FIELDS, JSONL_SUFFIXES, LABEL_FIELDS, TEXT_FIELDS, TEXT_SUFFIXES
from ..functions.text import strip

COLUMNS = ["doc_id", "text", "source", "label", "meta"]
#: Where a document stands: its file and line.
_ORDER = ["__file", "__line"]
STDIN = "<stdin>"


class CorpusError(RuntimeError):
    """A corpus that cannot be read."""


def _numbered(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``value, __file, __line``: lines with their numbers from 1 in the file, blank ones included.

    A file may be read in blocks: lines are numbered within a block by their order in the task, and the
    blocks' line counts (a row a block) give where each begins.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__at"), F.monotonically_increasing_id().alias("__n"))
    blocks = rows.groupBy("__file", "__at").agg(F.min("__n").alias("__first"), F.count(F.lit(1)).alias("__lines"))
    before = Window.partitionBy("__file").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("__before", F.coalesce(F.sum("__lines").over(before), F.lit(0))).drop("__lines")
    joined = rows.join(blocks, ["__file", "__at"])
    return joined.select("value", "__file", (F.col("__before") + F.col("__n") - F.col("__first") + 1).alias("__line"))


def _records(lines: DataFrame, text_field: str | None, min_chars: int) -> DataFrame:
    """Documents of ``value, __file, __line``; blank, malformed and non-object lines are skipped."""
    record = F.from_json("value", MapType(StringType(), StringType()), {"mode": "PERMISSIVE"})
    rows = lines.withColumns({"v": F.try_parse_json("value"), "m": record}).where(F.schema_of_variant("v").startswith("OBJECT") & F.col("m").isNotNull())

    def given(name: str, blank: bool) -> Column:
        s = F.col("m")[name]
        is_text = F.schema_of_variant(F.try_variant_get("v", f'$["{name}"]', "variant")) == "STRING"
        return F.when(is_text & (F.lit(True) if blank else strip(s) != ""), s)

    names = (text_field,) if text_field else TEXT_FIELDS
    text = F.coalesce(*[given(n, bool(text_field)) for n in names])
    used = F.coalesce(*[F.when(given(n, bool(text_field)).isNotNull(), F.lit(n)) for n in names])
    source = F.regexp_extract("__file", r"[^/]*$", 0)
    name = F.coalesce(*[given(n, False) for n in ID_FIELDS], F.concat(source, F.lit("#"), F.col("__line").cast("string")))
    out = rows.select(name.alias("doc_id"), text.alias("text"), source.alias("source"), F.coalesce(*[given(n, False) for n in LABEL_FIELDS]).alias("label"), F.map_filter("m", lambda k, _: k != used).alias("meta"), *_ORDER)
    return out.where(F.col("text").isNotNull() & (F.length("text") >= min_chars))


def read_jsonl(spark: SparkSession, path: str | list[str], text_field: str | None = None, min_chars: int = 0) -> DataFrame:
    """JSON lines, compressed or not.

    Without an id, a document is named by its file and line. An explicit text field may be blank.
    """
    return _records(_numbered(spark, path), text_field, min_chars).select(*COLUMNS)


def _whole(spark: SparkSession, path: str | list[str], root: str | None, min_chars: int) -> DataFrame:
    rows = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("__file"), F.lit(1).cast("long").alias("__line"))
    plain = F.regexp_replace("__file", r"^[a-z0-9+.-]+:(?://[^/]*)?/*", "/")
    name = F.regexp_extract("__file", r"[^/]*$", 0)
    if root:
        name = F.substr(plain, F.lit(len(root.rstrip("/")) + 2))
    out = rows.select(name.alias("doc_id"), F.col("value").alias("text"), name.alias("source"), F.lit(None).cast("string").alias("label"), F.create_map().cast("map<string,string>").alias("meta"), *_ORDER)
    return out.where((strip(F.col("text")) != "") & (F.length("text") >= min_chars))


def read_text_files(spark: SparkSession, path: str | list[str], root: str | None = None, min_chars: int = 0) -> DataFrame:
    """S3: a file is a document; named by its path below ``root``, or its base name; blank ones are none."""
    return _whole(spark, path, urlparse(root).path if root else None, min_chars).select(*COLUMNS)


def _files(spark: SparkSession, path: str) -> tuple[list[str], str | None]:
    """The files of a path (file, folder or glob), and the folder where it is one; hidden names are skipped."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    top = hadoop.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(top)
    if not found:
        raise CorpusError(f"{path} does not exist")
    one = found[0] if len(found) == 1 else None
    files: list[str] = []
    waiting = list(found)
    while waiting:
        status = waiting.pop()
        if status.isDirectory():
            waiting += [s for s in fs.listStatus(status.getPath()) if not s.getPath().getName().startswith(".")]
        else:
            files.append(status.getPath().toString())
    return sorted(files), one.getPath().toUri().getPath() if one is not None and one.isDirectory() else None


def read_stdin(spark: SparkSession, data: str, text_field: str | None = None, min_chars: int = 0) -> DataFrame:
    """What was piped in: JSON lines if it begins with an object, else one document."""
    lines = data.splitlines() if data.lstrip().startswith("{") else []
    if lines:
        rows = spark.createDataFrame([(line, STDIN, n) for n, line in enumerate(lines, 1)], "value string, __file string, __line long")
        return _records(rows, text_field, min_chars).orderBy("__line").select(*COLUMNS)
    kept = [(STDIN, data, STDIN, None, {})] if data.strip() and len(data) >= min_chars else []
    return spark.createDataFrame(kept, "doc_id string, text string, source string, label string, meta map<string,string>")


def read_corpus(spark: SparkSession, path: str, text_field: str | None = None, min_chars: int = 0, limit: int | None = None) -> DataFrame:
    """A file, a folder or a glob; endings choose the reader; ``limit`` counts kept documents, in the order of files and lines."""
    files, root = _files(spark, path)
    lined = [f for f in files if f.endswith(JSONL_SUFFIXES)]
    whole = [f for f in files if f.endswith(TEXT_SUFFIXES)] if root else [f for f in files if f not in lined]
    parts = ([_records(_numbered(spark, lined), text_field, min_chars)] if lined else []) + ([_whole(spark, whole, root, min_chars)] if whole else [])
    if not parts:
        raise CorpusError(f"{path} has no readable documents")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return (out.orderBy(*_ORDER).limit(limit) if limit is not None else out).select(*COLUMNS)


def from_table(df: DataFrame, text_field: str | None = None, id_field: str | None = None, min_chars: int = 0) -> DataFrame:
    """S6, S7 for any table (parquet, ORC, CSV, JDBC): doc_id and text by name, other columns kept."""
    names = [text_field] if text_field else [c for c in TEXT_FIELDS if c in df.columns]
    if not names or names[0] not in df.columns:
        raise CorpusError("no text column")
    text = F.col(names[0]) if text_field else F.coalesce(*[F.when(strip(F.col(c)) != "", F.col(c)) for c in names])
    ident = id_field or next((c for c in ID_FIELDS if c in df.columns), None)
    if ident is None:
        raise CorpusError("no id column")
    rest = [c for c in df.columns if c not in {names[0], ident, "doc_id", "text"}]
    return df.select(F.col(ident).alias("doc_id"), text.alias("text"), *rest).where(F.col("text").isNotNull() & (F.length("text") >= min_chars))


def write_jsonl(df: DataFrame, path: str) -> int:
    """JSON lines with sorted keys; gives the number of rows, counted as they are written."""
    from pyspark.sql import Observation

    seen = Observation()
    df.select(*sorted(df.columns)).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    return seen.get["n"]


def _sidecar(spark: SparkSession, path: str):
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.meta.json")
    return beside.getFileSystem(spark._jsc.hadoopConfiguration()), beside


def write_run(run, path: str) -> None:
    """Scores as JSON lines in corpus order, and ``<path>.meta.json`` beside them, in the same store."""
    order = "__row" if "__row" in run.rows.columns else "doc_id"
    run.rows.orderBy(order).drop("__row").write.mode("overwrite").json(path)
    fs, beside = _sidecar(run.rows.sparkSession, path)
    out = fs.create(beside, True)
    out.write(json.dumps({"meta": run.meta, "top": run.top}, sort_keys=True, default=str).encode())
    out.close()


def load_run(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """S10."""
    fs, beside = _sidecar(spark, path)
    if not fs.exists(beside):
        raise CorpusError(f"{path} is no stored run")
    told = spark.read.text(beside.toString(), wholetext=True).first()[0]
    return spark.read.json(path), json.loads(told)
