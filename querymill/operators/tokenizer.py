"""Byte-pair merges over the table of distinct pieces: counting and merging are distributed, the driver sees one pair a round."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querymill.session import materialize

BASE = 256


def pre_tokens(text: Column, seeds: Sequence[str] = ()) -> Column:
    """Pieces in order: seed words, runs of letters, single digits, runs of white space, any other character."""
    first = "".join(rf"(?<![\p{{L}}\p{{N}}]){s}(?![\p{{L}}\p{{N}}])|" for s in sorted(seeds, key=lambda s: (-len(s), s)))
    return F.regexp_extract_all(text, F.lit(rf"(?s)({first}\p{{L}}+|\p{{N}}|\s+|.)"), F.lit(1))


def piece_counts(df: DataFrame, text: str, seeds: Sequence[str] = ()) -> DataFrame:
    """(piece, n) over all rows; null texts have none."""
    return df.select(F.explode(pre_tokens(F.col(text), seeds)).alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("n"))


def byte_ids(piece: Column) -> Column:
    """UTF-8 bytes as ids 0 to 255."""
    h = F.hex(F.encode(piece, "UTF-8"))
    return F.transform(F.sequence(F.lit(0), (F.length(h) / 2).cast("int") - 1), lambda i: F.conv(F.substr(h, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))


def pair_counts(pieces: DataFrame) -> DataFrame:
    """(a, b, n): adjacent ids weighted by the piece's count. pieces: (ids, n)."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("ids") - 1), lambda i: F.struct(F.col("ids")[i - 1].alias("a"), F.col("ids")[i].alias("b")))
    return pieces.where(F.size("ids") > 1).select("n", F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.sum("n").alias("n"))


def merge(ids: Column, a: int, b: int, new: int) -> Column:
    """Replaces a, b by new from left to right, without overlap."""
    step = lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1) == a) & (x == b), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.lit(new)))).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(ids, F.array().cast("array<int>"), step)


def train_merges(df: DataFrame, text: str, rounds: int, seeds: Sequence[str] = (), first_id: int = BASE, checkpoint_every: int = 8) -> list[tuple[int, int, int]]:
    """(a, b, new) of each round: the most frequent pair, ties to the smaller pair; stops when no pair is left."""
    pieces = piece_counts(df, text, seeds)
    if seeds:
        pieces = pieces.where(~F.col("piece").isin(list(seeds)))
    state = materialize(pieces.select(byte_ids(F.col("piece")).alias("ids"), "n"), "pieces")
    merges: list[tuple[int, int, int]] = []
    for r in range(rounds):
        top = pair_counts(state).agg(F.min(F.struct((-F.col("n")).alias("k"), "a", "b")).alias("m")).first()["m"]
        if top is None:
            break
        new = first_id + r
        merges.append((top["a"], top["b"], new))
        state = state.select(F.when(F.array_contains("ids", top["a"]), merge(F.col("ids"), top["a"], top["b"], new)).otherwise(F.col("ids")).alias("ids"), "n")
        if r % checkpoint_every == checkpoint_every - 1:
            state = materialize(state, "pieces")
    return merges


def encode_piece(piece: str, ranks: dict[tuple[int, int], int], seeds: dict[str, int]) -> list[int]:
    if piece in seeds:
        return [seeds[piece]]
    ids = list(piece.encode())
    while len(ids) > 1:
        best = min(range(len(ids) - 1), key=lambda i: ranks.get((ids[i], ids[i + 1]), 1 << 60))
        pair = (ids[best], ids[best + 1])
        if pair not in ranks:
            break
        out, i = [], 0
        while i < len(ids):
            if i + 1 < len(ids) and (ids[i], ids[i + 1]) == pair:
                out.append(ranks[pair])
                i += 2
            else:
                out.append(ids[i])
                i += 1
        ids = out
    return ids


def encode(df: DataFrame, key: str, text: str, merges: Sequence[tuple[int, int, int]], seeds: dict[str, int] | None = None) -> DataFrame:
    """(key, ids): each distinct piece is encoded once, in Arrow batches, and joined back in order. Texts without piece have none."""
    ranks, seeds = {(a, b): new for a, b, new in merges}, seeds or {}
    placed = df.select(key, F.posexplode(pre_tokens(F.col(text), list(seeds))).alias("pos", "piece"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(ids=[encode_piece(x, ranks, seeds) for x in b["piece"]])

    coded = placed.select("piece").distinct().mapInPandas(run, "piece string, ids array<int>")
    rows = placed.join(coded, "piece").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("s"))
    return rows.select(key, F.flatten(F.transform("s", lambda x: x["ids"])).alias("ids"))


def decode(ids: list[int], merges: Sequence[tuple[int, int, int]], seeds: dict[str, int] | None = None) -> str | None:
    """The text of ids; None when the bytes are not UTF-8."""
    table = {i: bytes([i]) for i in range(BASE)} | {i: s.encode() for s, i in (seeds or {}).items()}
    for a, b, new in merges:
        table[new] = table[a] + table[b]
    try:
        return b"".join(table[i] for i in ids).decode()
    except (KeyError, UnicodeDecodeError):
        return None


def seed_problems(seeds: Sequence[str]) -> list[str]:
    """Why seed words cannot be used: repeated, shorter than two characters, or with blanks around them."""
    out = ["repeated seeds"] if len(set(seeds)) < len(seeds) else []
    return out + [f"too short: {s!r}" for s in seeds if len(s) < 2] + [f"blanks around: {s!r}" for s in seeds if s != s.strip()]


@dataclass(frozen=True)
class Layout:
    """Where a vocabulary has its ids: bytes below 256, special ids, seeds from seed_base on, merges from merge_base on."""

    pad: int
    bos: int
    eos: int
    sep: int
    seed_base: int
    merge_base: int
    seeds: tuple[str, ...] = ()

    def problems(self, vocabulary: int) -> list[str]:
        """What contradicts the contract; empty for a sound layout."""
        special = {"pad": self.pad, "bos": self.bos, "eos": self.eos, "sep": self.sep}
        ids = [*special.values(), self.seed_base, self.merge_base]
        if any(type(i) is not int or i < BASE for i in ids):
            return ["ids must be whole numbers from 256 on"]
        seed_ids = range(self.seed_base, self.seed_base + len(self.seeds))
        checks = {
            "ranges exceed the vocabulary": not self.seed_base <= self.merge_base <= vocabulary,
            "seeds reach into the merges": len(self.seeds) > self.merge_base - self.seed_base,
            "seeds must be ASCII of two bytes or more without blanks around": any(not s.isascii() or "\0" in s for s in self.seeds) or bool([x for x in seed_problems(self.seeds) if x != "repeated seeds"]),
            "repeated seeds": len(set(self.seeds)) < len(self.seeds),
            "special ids are not different": len(set(special.values())) < len(special),
            "special ids lie in other ranges": any(i >= self.merge_base or i in seed_ids for i in special.values()),
        }
        return [reason for reason, broken in checks.items() if broken]


def round_trip_report(df: DataFrame, key: str, text: str, merges: Sequence[tuple[int, int, int]], seeds: dict[str, int], wanted: int) -> DataFrame:
    """One row: texts, texts that encoding and decoding change, mean and most tokens, merges, and whether pairs ran out before
    the wanted number of merges. Null texts are left out; an empty text has 0 tokens."""
    given = df.where(F.col(text).isNotNull()).select(key, text)

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = [list(x) if x is not None else [] for x in b["ids"]]
            yield pd.DataFrame({"n": [len(x) for x in ids], "bad": [decode([int(i) for i in x], merges, seeds) != t for x, t in zip(ids, b["t"])]})

    coded = given.join(encode(given, key, text, merges, seeds), key, "left").select(F.col(text).alias("t"), "ids").mapInPandas(check, "n long, bad boolean")
    return coded.agg(
        F.count(F.lit(1)).alias("n_texts"), F.count_if("bad").alias("n_errors"), F.round(F.avg("n"), 4).alias("mean_tokens"), F.max("n").alias("most_tokens"),
        F.lit(len(merges)).alias("n_merges"), F.lit(len(merges) < wanted).alias("exhausted"),
    )


def framed(question: Column, statement: Column, bos: int, sep: int, eos: int) -> tuple[Column, Column]:
    """[bos] question [sep] statement [eos], and where the statement begins (from 0)."""
    one = lambda i: F.array(F.lit(i))
    return F.concat(one(bos), question, one(sep), statement, one(eos)), F.size(question) + 2


def padded(ids: Column, start: Column, width: int | Column, pad: int) -> Column:
    """Struct of inputs and targets shifted by one, both padded to width, and the loss mask over the statement. Longer rows are an error."""
    w = F.lit(width) if isinstance(width, int) else width
    fits = F.when(F.size(ids) - 1 > w, F.raise_error(F.lit("row longer than width")).cast("int")).otherwise(w)
    fill = lambda c, v: F.slice(F.concat(c, F.array_repeat(F.lit(v), fits)), F.lit(1), fits)
    inputs, targets = F.slice(ids, F.lit(1), F.greatest(F.size(ids) - 1, F.lit(0))), F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 1, F.lit(0)))
    mask = F.transform(F.sequence(F.lit(1), w), lambda i: (i >= start) & (i < F.size(ids)))
    return F.struct(fill(inputs, pad).alias("inputs"), fill(targets, pad).alias("targets"), mask.alias("mask"))


def collated(df: DataFrame, ids: str, start: str, pad: int, step: int = 16) -> DataFrame:
    """df with batch and row (padded): rows of a length class are a batch, padded to its longest row; nothing is cut."""
    rows = df.withColumn("batch", F.ceil(F.size(ids) / F.lit(step)).cast("int"))
    widths = rows.groupBy("batch").agg((F.max(F.size(ids)) - 1).alias("width"))
    return rows.join(F.broadcast(widths), "batch").withColumn("row", padded(F.col(ids), F.col(start), F.col("width"), pad))


def remapped(ids: Column, to_base: int, n_special: int) -> Column:
    """Ids between layouts: special ids move from the front (0..n_special-1) to behind to_base, others shift down."""
    return F.transform(ids, lambda i: F.when(i < n_special, i + to_base).otherwise(i - n_special))


def warm_cosine(step: Column, warm: int, total: int, top: float, low: float) -> Column:
    """Linear warm-up to top, then half a cosine down to low."""
    done = F.least((step - warm) / F.lit(float(total - warm)), F.lit(1.0))
    return F.when(step < warm, F.lit(top) * (step + 1) / warm).otherwise(low + (top - low) * (1 + F.cos(F.lit(3.141592653589793) * done)) / 2)
