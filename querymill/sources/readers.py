"""Readers of the file forms the operators use. Schemas are explicit wherever the form is fixed."""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAIR_SCHEMA = """question string, sql string, sql_group string, source string, round string, contrast_group string, contrast_kind string, contrast_role string,
style int, persona string, platform string, split string, `set` string, eval_slot string, orig_question string, orig_sql string, swapped boolean"""


def read_json_array(spark: SparkSession, path: str | Sequence[str], schema: str | None = None) -> DataFrame:
    """Files that hold one JSON array of objects each, plain or gzip, with or without byte order mark. Missing keys are null.

    A row's file is in `file_name`, and `file_no` is its place in the order of names; rows of unreadable files have all nulls in
    permissive mode and are dropped.
    """
    reader = spark.read.option("multiLine", True)
    df = (reader.schema(schema) if schema else reader).json(list(path) if not isinstance(path, str) else path)
    names = df.columns
    named = df.withColumn("file_name", F.col("_metadata.file_path")).dropna(how="all", subset=names)
    bare = lambda n: re.sub("^file:/+", "file:/", n)
    order = spark.createDataFrame([(bare(n), i) for i, n in enumerate(sorted(df.inputFiles()))], "__f string, file_no int")
    return named.join(order, F.regexp_replace("file_name", "^file:/+", "file:/") == F.col("__f"), "left").select(*names, "file_name", "file_no")


def read_evaluation_set(spark: SparkSession, name: str, folder: str, combined: DataFrame | None = None, metadata: DataFrame | None = None) -> DataFrame:
    """The pairs of one evaluation set: from folder/name where that folder exists, else the rows of combined with this `set`.

    metadata (sql): every statement of the set must be in it (by sql_group, else sql); ValueError names one that is not, or
    the set if nothing has it.
    """
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        rows = read_json_array(spark, f"{folder}/{name}/*.json*", PAIR_SCHEMA)
    elif combined is not None:
        rows = combined.where(F.col("set") == name)
    else:
        raise ValueError(f"no evaluation set {name}")
    if metadata is not None:
        used = rows.select(F.coalesce("sql_group", "sql").alias("sql")).distinct()
        lost = used.join(metadata.select("sql"), "sql", "left_anti").first()
        if lost is not None:
            raise ValueError(f"no metadata for {lost['sql']}")
    return rows


def read_pairs(spark: SparkSession, folders: Sequence[str], glob: str = "*.json*") -> DataFrame:
    """Corpus files of several folders as one table with the place of their folder (`file_ord`); later folders come last."""
    out = None
    for i, folder in enumerate(folders):
        one = read_json_array(spark, f"{folder}/{glob}", PAIR_SCHEMA).withColumn("file_ord", F.lit(i))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def read_csv_answers(spark: SparkSession, path: str, preferred: DataFrame | None = None) -> DataFrame:
    """(id, question) of a CSV with header; the first row of an id wins, and ids of preferred are left to it."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema("id long, question string").csv(path)
    w = Window.partitionBy("id").orderBy("__n")
    own = raw.withColumn("__n", F.monotonically_increasing_id()).withColumn("__r", F.row_number().over(w)).where("__r = 1 and id is not null").select("id", "question")
    return own if preferred is None else preferred.select("id", "question").unionByName(own.join(preferred.select("id"), "id", "left_anti"))


def _zipped_lines(spark: SparkSession, path: str, member: str) -> DataFrame:
    """(value): lines of the members of a zip archive whose name matches a pattern."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    for name in sorted(n for n in z.namelist() if re.search(member, n)):
                        yield pd.DataFrame({"value": z.read(name).decode("utf-8", "replace").splitlines()})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "value string")


def read_words(spark: SparkSession, path: str, member: str = r"index\.\w+$") -> DataFrame:
    """(word): distinct lower-case words of a text file, one or more a line, comments (#) aside.

    Of a zip archive, the first word of every line of the index members is taken, underscores as blanks; indented lines are its notice.
    """
    if path.endswith(".zip"):
        lines = _zipped_lines(spark, path, member).where(~F.col("value").startswith(" "))
        return lines.select(F.lower(F.replace(F.split_part("value", F.lit(" "), F.lit(1)), F.lit("_"), F.lit(" "))).alias("word")).where("word <> ''").distinct()
    lines = spark.read.text(path).where(~F.col("value").startswith("#"))
    return lines.select(F.explode(F.split(F.lower(F.trim("value")), r"\s+")).alias("word")).where("word <> ''").distinct()


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(word, embedding): text lines of a word and its numbers; lines with another number of values than the first are left out."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), " ").alias("p")).where(F.size("p") > 2)
    dim = parts.select((F.size("p") - 1).alias("d")).first()
    if dim is None:
        return spark.createDataFrame([], "word string, embedding array<float>")
    return parts.where(F.size("p") == dim["d"] + 1).select(F.col("p")[0].alias("word"), F.transform(F.slice("p", 2, dim["d"]), lambda x: x.try_cast("float")).alias("embedding"))


def read_lexical_graph(spark: SparkSession, data: str, exceptions: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lemmas, edges, exceptions) of a lexical database in its published text form.

    data lines: offset, file, class, word count (hexadecimal), word and sense pairs, pointer count, pointers (symbol,
    offset, class, source) and a gloss after '|'. lemmas: (pos, lemma, node); edges: (src, dst) along synonym, hypernym
    and hyponym pointers; exceptions: (pos, form, base) from lines of a form and its bases.
    """
    lines = spark.read.text(data).where(~F.col("value").startswith("  ") & F.col("value").rlike(r"^\d{8} "))
    f = lines.select(F.split(F.trim(F.split_part("value", F.lit(" | "), F.lit(1))), " ").alias("f"))
    n = F.conv(F.col("f")[3], 16, 10).cast("int")
    node = F.concat(F.col("f")[2], F.lit(":"), F.col("f")[0])
    rows = f.select("f", n.alias("n"), node.alias("node"), F.col("f")[2].alias("pos"))
    lemma = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.lower(F.replace(F.col("f")[4 + i * 2], F.lit("_"), F.lit(" "))))
    lemmas = rows.select("pos", F.explode(lemma).alias("lemma"), "node")
    count = F.col("f")[4 + F.col("n") * 2].cast("int")
    pointers = rows.withColumn("k", count).where("k > 0")
    at = lambda i, j: F.col("f")[5 + F.col("n") * 2 + i * 4 + j]
    each = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.struct(at(i, 0).alias("symbol"), F.concat(at(i, 2), F.lit(":"), at(i, 1)).alias("dst")))
    edges = pointers.select(F.col("node").alias("src"), F.explode(each).alias("p")).where(F.col("p.symbol").isin("@", "~", "&", "@i", "~i")).select("src", F.col("p.dst").alias("dst")).distinct()
    schema = "pos string, form string, base string"
    if exceptions is None:
        return lemmas, edges, spark.createDataFrame([], schema)
    e = spark.read.text(exceptions).select(F.regexp_extract(F.input_file_name(), r"(\w+)\.exc", 1).alias("pos"), F.split(F.trim("value"), " ").alias("p"))
    return lemmas, edges, e.select("pos", F.col("p")[0].alias("form"), F.explode(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(1)))).alias("base")).where("base is not null")


def catalog_columns(spark: SparkSession, database: str | None = None) -> DataFrame:
    """(table_name, column_name) of the session's catalog."""
    rows = [(t.name, c.name) for t in spark.catalog.listTables(database) for c in spark.catalog.listColumns(t.name)]
    return spark.createDataFrame(rows, "table_name string, column_name string")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(name, n_bytes, sha256, content_sha256) of every file below path; content_sha256 is of the decompressed content of a gzip file,
    null for other files and for one that cannot be read."""

    def inner(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, content in zip(b["name"], b["content"]):
                try:
                    out.append(hashlib.sha256(gzip.decompress(bytes(content))).hexdigest() if name.endswith(".gz") else None)
                except (OSError, EOFError):
                    out.append(None)
            yield b[["name", "n_bytes", "sha256"]].assign(content_sha256=out)

    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    named = df.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"), "content")
    return named.mapInPandas(inner, "name string, n_bytes long, sha256 string, content_sha256 string")
