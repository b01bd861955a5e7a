"""Answers of a text generator that should be JSON arrays and often are not quite."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

THINK = re.compile(r"<think>.*?(?:</think>|$)", re.S | re.I)
FENCE = re.compile(r"```[a-z]*", re.I)
OBJECT = re.compile(r'\{[^{}]*"id"\s*:\s*(\d+)[^{}]*?"questions"\s*:\s*\[(.*?)\][^{}]*\}', re.S)
STRING = re.compile(r'"((?:[^"\\]|\\.)*)"')


def read_array(raw: str | None) -> tuple[list[dict] | None, str]:
    """(items, how): parsed as it stands, after repair of brackets and commas, or object by object; None with the reason.

    Anything but a clean parse counts only when it gives as many items as the text has "id" keys.
    """
    if not raw or not raw.strip():
        return None, "empty"
    text = FENCE.sub("", THINK.sub("", raw)).strip()
    begin = text.find("[")
    body = text[begin : text.rfind("]") + 1] if begin >= 0 and "]" in text[begin:] else text[max(begin, 0) :]
    try:
        got = json.loads(body)
        return (got, "parsed") if isinstance(got, list) else (None, "no array")
    except ValueError:
        pass
    wanted = len(re.findall(r'"id"\s*:', text))
    mended = re.sub(r"}\s*{", "},{", body)
    mended = re.sub(r",\s*([\]}])", r"\1", mended)
    for tail in ("", "]", "}]", "]}]"):
        head = "" if mended.lstrip().startswith("[") else "["
        try:
            got = json.loads(head + mended + tail)
        except ValueError:
            continue
        if isinstance(got, list) and len(got) == wanted:
            return got, "repaired"
    salvaged = [{"id": int(i), "questions": [json.loads(f'"{q}"') for q in STRING.findall(qs)]} for i, qs in OBJECT.findall(text)]
    return (salvaged, "salvaged") if salvaged and len(salvaged) == wanted else (None, "unreadable")


def read_responses(df: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, how, id, questions): one row per answer item; an unreadable answer has one row with null id and the reason."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, r in zip(b["k"], b["r"]):
                items, how = read_array(r)
                good = [x for x in items or [] if isinstance(x, dict) and isinstance(x.get("id"), int)]
                rows += [(k, how, x["id"], [q for q in x.get("questions") or [] if isinstance(q, str)]) for x in good] or [(k, how, None, [])]
            yield pd.DataFrame(rows, columns=["k", "how", "id", "questions"]).astype({"id": "Int64"})

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("k"), F.col(raw).alias("r")).mapInPandas(run, f"k {kind}, how string, id long, questions array<string>").withColumnRenamed("k", key)


def read_response_folder(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(answers, errors, repeated) of a folder of answer files, in the order of their names.

    answers: (id, questions), of an id that occurs in several files, or several times in one, the last one; errors: (file,
    reason) of files without a readable answer; repeated: (id, n) of ids that were overwritten.
    """
    files = spark.read.option("wholetext", True).text(path).select(F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1).alias("file"), F.col("value").alias("raw"))
    rows = read_responses(files, "file", "raw").withColumn("n", F.monotonically_increasing_id())
    found = rows.where("id is not null")
    answers = found.groupBy("id").agg(F.max_by("questions", F.struct("file", "n")).alias("questions"))
    errors = rows.where("id is null").select("file", F.col("how").alias("reason"))
    return answers, errors, found.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
