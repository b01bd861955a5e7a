"""Filling fixed-capacity containers (problem 6) by shortest-pack-first over the length histogram.

The driver sees the histogram only (at most `capacity` numbers). Lengths are placed longest first, always into the
shortest open pack that still has room; packs alike are one pattern with a count. Patterns are joined back to items by
the item's rank within its length. Work on the driver depends on the capacity, not on the number of items.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querymill.llm.tokens import VOCABULARY, with_token_counts
from querymill.operators.ranking import random_key, rank_in_group
from querymill.session import materialize


@dataclass
class Pattern:
    """count packs, each holding k items of each length."""

    count: int
    items: dict[int, int]


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Packs for a histogram of lengths 1..capacity."""
    by_room: dict[int, list[Pattern]] = defaultdict(list)
    rooms: list[int] = []  # sorted rooms with patterns

    def add(room: int, pattern: Pattern) -> None:
        if not by_room[room]:
            from bisect import insort

            insort(rooms, room)
        by_room[room].append(pattern)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is outside 1..{capacity}")
        while left:
            room = rooms[-1] if rooms and rooms[-1] >= length else None
            if room is None:
                fit = capacity // length  # new packs take as many as they hold, evenly over the packs
                packs = -(-left // fit)
                each, more = divmod(left, packs)
                for count, k in ((more, each + 1), (packs - more, each)):
                    if count and k:
                        add(capacity - k * length, Pattern(count, {length: k}))
                left = 0
                continue
            old = by_room[room].pop()
            if not by_room[room]:
                rooms.pop()
            used = min(old.count, left)
            if old.count > used:
                add(room, Pattern(old.count - used, dict(old.items)))
            add(room - length, Pattern(used, old.items | {length: old.items.get(length, 0) + 1}))
            left -= used
    return [p for room in rooms for p in by_room[room]]


def slots(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int]]:
    """(length, lo, hi, per_pack, first_pack): items of this length with lo < rank <= hi go to first_pack + (rank - lo - 1) // per_pack."""
    out, pack, used = [], 0, defaultdict(int)
    for p in patterns:
        for length, k in sorted(p.items.items()):
            lo = used[length]
            out.append((length, lo, lo + k * p.count, k, pack))
            used[length] += k * p.count
        pack += p.count
    return out


def pieces(sized: DataFrame, capacity: int) -> DataFrame:
    """Items of at most capacity: whole texts, and the parts of larger ones (full parts, then the rest)."""
    n = F.ceil(F.col("n_tokens") / F.lit(capacity)).cast("int")
    each = sized.where("n_tokens > 0").withColumn("n_pieces", n).withColumn("piece_no", F.explode(F.sequence(F.lit(1), F.col("n_pieces"))))
    start = (F.col("piece_no") - 1).cast("long") * capacity
    return each.select("doc_id", "piece_no", "n_pieces", start.alias("start_token"), F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - start).alias("length"))


#: Ranks that share a key when items look for their slot.
RANK_RUN = 64


def in_slots(ranked: DataFrame, plan: DataFrame) -> DataFrame:
    """Every item with the slot of its length that holds its rank. Both sides meet by (length, run of ranks), so an item
    meets the slots of its run only, and the items of a frequent length are spread over tasks."""
    last = F.floor((F.col("hi") - 1) / RANK_RUN)
    runs = plan.withColumn("run", F.explode(F.sequence(F.floor(F.col("lo") / RANK_RUN), last)))
    keyed = ranked.withColumn("run", F.floor((F.col("rank") - 1) / RANK_RUN))
    return keyed.join(runs, ["length", "run"]).where("rank > lo and rank <= hi")


def pack_documents(docs: DataFrame, packs: DataFrame, path: str = VOCABULARY, seed: int = 42) -> DataFrame:
    """(pack_name, pack_id, doc_id, piece_no, n_pieces, start_token, length): each item's place for each kind of pack.

    Texts without tokens (null or empty) take no room and are left out. packs: (pack_name, capacity_tokens), a few rows.
    """
    spark = docs.sparkSession
    sized = materialize(with_token_counts(docs, "text", ["doc_id"], path), "sized")
    out = None
    for r in packs.orderBy("pack_name").collect():
        capacity = int(r["capacity_tokens"])
        items = pieces(sized, capacity)
        histogram = {h["length"]: h["n"] for h in items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
        plan = spark.createDataFrame(slots(shortest_pack_first(histogram, capacity)), "length long, lo long, hi long, per_pack long, first_pack long")
        ranked = rank_in_group(items, ["length"], random_key(seed, "doc_id", "piece_no"), ["doc_id", "piece_no"])
        pack_id = F.col("first_pack") + F.floor((F.col("rank") - F.col("lo") - 1) / F.col("per_pack"))
        placed = in_slots(ranked, plan)
        rows = placed.select(F.lit(r["pack_name"]).alias("pack_name"), pack_id.cast("long").alias("pack_id"), "doc_id", "piece_no", "n_pieces", "start_token", "length")
        out = rows if out is None else out.unionByName(rows)
    empty = spark.createDataFrame([], "pack_name string, pack_id long, doc_id long, piece_no int, n_pieces int, start_token long, length long")
    return empty if out is None else out


def pack_report(docs: DataFrame, packs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Per kind of pack: packs, items, tokens and the share of room filled."""
    placed = pack_documents(docs, packs, path)
    got = placed.groupBy("pack_name").agg(F.count(F.lit(1)).alias("n_items"), F.sum("length").alias("n_tokens"), (F.max("pack_id") + 1).alias("n_packs"))
    fill = F.round(F.col("n_tokens") / (F.col("n_packs") * F.col("capacity_tokens")), 6)
    return got.join(packs, "pack_name").select("pack_name", "capacity_tokens", "n_items", "n_packs", "n_tokens", fill.alias("filled"))


def split_documents(docs: DataFrame, packs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(pack_name, doc_id) of the documents that had to be split: larger than the pack's capacity."""
    return pack_documents(docs, packs, path).where("n_pieces > 1 and piece_no = 1").select("pack_name", "doc_id")
