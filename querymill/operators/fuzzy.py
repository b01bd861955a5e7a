"""Approximate matching of words and vectors: dictionaries of any size, and query sets against all rows in blocks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querymill.session import materialize


def ngrams(word: Column, n: int = 2) -> Column:
    """Distinct runs of n characters; a shorter word gives none."""
    k = F.length(word) - (n - 1)
    return F.when(k > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), lambda i: F.substr(word, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def ngram_best(words: DataFrame, dictionary: DataFrame, n: int = 2, threshold: float = 0.3) -> DataFrame:
    """(word, match, similarity): the dictionary word with the highest Jaccard of n-grams, from threshold; ties to the smaller.

    Candidates meet by a shared n-gram (an equi-join), so words that share none are never compared.
    """
    a = words.select("word").distinct().withColumn("g", ngrams(F.col("word"), n))
    b = dictionary.select(F.col("word").alias("match")).distinct().withColumn("h", ngrams(F.col("match"), n))
    left = a.select("word", F.size("g").alias("na"), F.explode("g").alias("gram"))
    right = b.select("match", F.size("h").alias("nb"), F.explode("h").alias("gram"))
    both = left.join(right, "gram").groupBy("word", "match", "na", "nb").agg(F.count(F.lit(1)).alias("k"))
    score = F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))
    best = both.withColumn("s", score).where(F.col("s") >= threshold).groupBy("word").agg(F.min(F.struct((-F.col("s")).alias("s"), "match")).alias("m"))
    return best.select("word", F.col("m.match").alias("match"), F.round(-F.col("m.s"), 6).alias("similarity"))


def _letters(word: Column) -> Column:
    """Characters, each numbered by its occurrence, in one order for all words: as a set they stand for the bag of characters."""
    chars = F.array_sort(F.filter(F.split(word, ""), lambda c: c != ""))
    return F.transform(chars, lambda c, i: F.concat(c, (i - F.array_position(chars, c) + 1).cast("string")))


def sharing_pairs(words: DataFrame, dictionary: DataFrame, least: float) -> DataFrame:
    """Distinct (word, match) among which are all pairs with least x length or more characters in common, of either word's length.

    Two such words share a character within the first n - least x n + 1 of either's ordered characters, so they meet on one of
    these; words that cannot be that alike mostly never meet.
    """
    def prefix(df: DataFrame, name: str) -> DataFrame:
        own = df.select(F.col("word").alias(name)).where("word is not null and word <> ''").distinct()
        width = F.length(name) - F.ceil(F.length(name) * least - 1e-9).cast("int") + 1
        return own.select(name, F.explode(F.slice(_letters(F.col(name)), F.lit(1), width)).alias("__c"))

    return prefix(words, "word").join(prefix(dictionary, "match"), "__c").select("word", "match").distinct()


def levenshtein_best(words: DataFrame, dictionary: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(word, match, ratio): the dictionary word with the highest 1 - distance / longer length, from threshold; ties to the smaller.
    Words with that ratio have threshold x length or more characters in common. Null and empty words match nothing."""
    ratio = 1 - F.levenshtein("word", "match") / F.greatest(F.length("word"), F.length("match"))
    scored = sharing_pairs(words, dictionary, threshold).withColumn("r", F.round(ratio, 6)).where(F.col("r") >= threshold)
    best = scored.groupBy("word").agg(F.min(F.struct((-F.col("r")).alias("r"), "match")).alias("m"))
    return best.select("word", F.col("m.match").alias("match"), (-F.col("m.r")).alias("ratio"))


def sequence_best(words: DataFrame, dictionary: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(word, match, ratio) by matching blocks (twice the matched characters over both lengths), from threshold; ties to the smaller.

    From that ratio on, threshold / (2 - threshold) of either word's characters are in common; only such pairs are compared,
    in Arrow batches. Null and empty words match nothing.
    """
    pairs = sharing_pairs(words, dictionary, threshold / (2 - threshold))

    def ratio(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            m, out = SequenceMatcher(), []
            for w, x in zip(b["word"], b["match"]):
                m.set_seqs(x, w)
                out.append(m.ratio() if m.real_quick_ratio() >= threshold and m.quick_ratio() >= threshold else 0.0)
            yield b.assign(ratio=out)

    scored = pairs.mapInPandas(ratio, "word string, match string, ratio double").where(F.col("ratio") >= threshold)
    best = scored.groupBy("word").agg(F.min(F.struct((-F.col("ratio")).alias("r"), "match")).alias("m"))
    return best.select("word", F.col("m.match").alias("match"), F.round(-F.col("m.r"), 6).alias("ratio"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 when either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def _block_pairs(rows: DataFrame, queries: DataFrame, key: str, vector: str, block: int) -> DataFrame:
    """(ids, data, query_ids, query_data): every pack of rows with every block of about `block` queries, as matrices of unit vectors.

    Neither side is collected: the blocks are a table, sent to all tasks by Spark only where it is small enough.
    """
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    n = max(1, -(-asked.count() // block))
    grouped = asked.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("block")).agg(F.collect_list(F.struct("id", "v")).alias("s"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows_ = [(k, [r["id"] for r in s], _unit([r["v"] for r in s]).tobytes()) for k, s in zip(b["block"], b["s"])]
            yield pd.DataFrame(rows_, columns=["block", "query_ids", "query_data"])

    def packs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame([(b["id"].tolist(), _unit(b["v"].tolist()).tobytes())], columns=["ids", "data"])

    blocks = materialize(grouped.mapInPandas(pack, "block int, query_ids array<long>, query_data binary"), "query-blocks")
    given = rows.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    packed = given.mapInPandas(packs, "ids array<long>, data binary").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return packed.join(blocks, "block").drop("block")


def _unit(vectors: Sequence) -> np.ndarray:
    x = np.array([list(v) for v in vectors], np.float64)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _matrix(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(n, -1)


def nearest_vectors(rows: DataFrame, queries: DataFrame, key: str, vector: str, top: int = 1, block: int = 2048) -> DataFrame:
    """(query_id, rank, match_id, similarity): the top rows by cosine for each query, itself aside.

    Blocks of queries meet packs of rows; each meeting keeps its best `top` per query, and a ranking merges them. Ties go
    to the smaller id. Null vectors match nothing, vectors of length 0 have similarity 0. All vectors have one length.
    """

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for ids, data, query_ids, query_data in zip(b["ids"], b["data"], b["query_ids"], b["query_data"]):
                keys, asked = np.array(ids, np.int64), np.array(query_ids, np.int64)
                s = np.round(_matrix(query_data, len(asked)) @ _matrix(data, len(keys)).T, 9)
                s[asked[:, None] == keys[None, :]] = -2
                order = np.lexsort((np.broadcast_to(keys, s.shape), -s), axis=1)[:, :top]
                val = np.take_along_axis(s, order, 1).ravel()
                yield pd.DataFrame({"query_id": np.repeat(asked, order.shape[1]), "match_id": keys[order].ravel(), "similarity": val})[val > -2]

    scored = _block_pairs(rows, queries, key, vector, block).mapInPandas(score, "query_id long, match_id long, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "match_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("query_id", "rank", "match_id", F.round("similarity", 4).alias("similarity"))


def near_any(rows: DataFrame, targets: DataFrame, key: str, vector: str, threshold: float, block: int = 2048) -> DataFrame:
    """Distinct ids of the rows whose cosine with any target reaches threshold. All targets count, in blocks."""

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for ids, data, query_ids, query_data in zip(b["ids"], b["data"], b["query_ids"], b["query_data"]):
                s = _matrix(data, len(ids)) @ _matrix(query_data, len(query_ids)).T
                yield pd.DataFrame({key: np.array(ids, np.int64)[(s >= threshold).any(axis=1)]})

    return _block_pairs(rows, targets, key, vector, block).mapInPandas(keep, f"{key} long").distinct()


def mean_pool(df: DataFrame, by: Sequence[str], vector: str, digits: int = 5) -> DataFrame:
    """Component-wise mean per group, by one aggregation over (group, position). Null vectors are left out."""
    long = df.select(*by, F.posexplode(vector).alias("i", "v"))
    means = long.groupBy(*by, "i").agg(F.round(F.avg("v"), digits).alias("m"))
    return means.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("mean_vector"))


def first_change(word: Column, *attempts: Column) -> Column:
    """The first attempt that differs from the word and is not null, else the word."""
    return F.coalesce(*[F.nullif(a, word) for a in attempts], word)


def like_case(source: Column, target: Column) -> Column:
    """target in the case of source: upper for upper, capital for capital."""
    capital = F.concat(F.upper(F.substring(target, 1, 1)), F.substr(target, F.lit(2)))
    return F.when((F.upper(source) == source) & (F.lower(source) != source), F.upper(target)).when(F.substring(source, 1, 1) != F.lower(F.substring(source, 1, 1)), capital).otherwise(target)


def snake_parts(word: Column) -> Column:
    return F.filter(F.split(F.lower(word), "_"), lambda x: x != "")
