"""Synthetic shop tables: balanced columns, covered foreign keys, hold-outs. Every choice is a rank of a seeded hash."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querymill.dialect.rules import is_iso_date
from querymill.operators.ranking import hash_rank, largest_remainder
from querymill.operators.sampling import product, seeded


@dataclass(frozen=True)
class ShopConfig:
    customers: int = 600
    items: int = 400
    orders: int = 6000
    customer_ids: tuple[int, int] = (1000, 1999)
    item_ids: tuple[int, int] = (3000, 3999)
    order_ids: tuple[int, int] = (5000, 14999)
    floor: int = 20
    zero_stock: int = 10
    dates: tuple[str, str] = ("2025-01-01", "2026-12-31")
    held_dates: float = 0.05
    seed: int = 42

    def problems(self) -> list[str]:
        """Why the tables cannot be built; empty when they can."""
        out = []
        for name, n, (lo, hi) in (("customers", self.customers, self.customer_ids), ("items", self.items, self.item_ids), ("orders", self.orders, self.order_ids)):
            if hi - lo + 1 < n:
                out.append(f"{name}: {n} rows in {hi - lo + 1} ids")
        if self.orders < max(self.customers, self.items):
            out.append("orders cannot cover every customer and item")
        kinds = {"cities": (3, self.customers), "memberships": (3, self.customers), "categories": (3, self.items), "states": (4, self.orders)}
        out += [f"{k}: {n} x {self.floor} rows of {rows}" for k, (n, rows) in kinds.items() if n * self.floor > rows]
        if self.zero_stock > self.items:
            out.append("more sold-out items than items")
        if not all(map(is_iso_date, self.dates)) or self.dates[0] > self.dates[1]:
            out.append("dates are ISO days, the first not after the last")
        if not 0 <= self.held_dates < 1:
            out.append("the share of held-out dates is from 0 to below 1")
        return out


#: Sizes of shops by name.
PRESETS = {
    "small": ShopConfig(80, 40, 150, (100, 399), (400, 699), (700, 999), floor=5, zero_stock=3),
    "large": ShopConfig(),
    "aggregate": ShopConfig(600, 400, 6000, order_ids=(5000, 14999), floor=50, zero_stock=26),
}


def preset(name: str, **overrides) -> ShopConfig:
    """A preset with some values replaced."""
    return replace(PRESETS[name], **overrides)


def sample_ids(spark: SparkSession, lo: int, hi: int, n: int, seed: int | str, name: str) -> DataFrame:
    """n distinct ids of a range."""
    return spark.range(lo, hi + 1).withColumnRenamed("id", name).orderBy(seeded(seed, name), name).limit(n)


def balanced(df: DataFrame, key: str, values: Sequence[str], floor: int, name: str, seed: int | str, caps: dict[str, int] | None = None) -> DataFrame:
    """Adds a column in which every value has at least floor rows (if they suffice) and at most its cap; the rest falls by hash.

    caps: value -> most rows. What a capped value cannot take goes to the others; ValueError when the caps leave too little room.
    """
    if caps:
        n = df.count()
        room = [min(caps.get(v, n), n) for v in values]
        if sum(room) < n or any(floor > r for r in room):
            raise ValueError("caps leave too little room")
        shares = largest_remainder([1.0] * len(values), n, [floor] * len(values), room)
        ends, at = [], 0
        for v, k in zip(values, shares):
            at += k
            ends.append((v, at))
        chosen = F.coalesce(*[F.when(F.col("__r") <= end, F.lit(v)) for v, end in ends])
        return hash_rank(df, [], seeded(seed, key), [key], "__r").withColumn(name, chosen).drop("__r")
    k = len(values)
    ranked = hash_rank(df, [], seeded(seed, key), [key], "__r").withColumn("__r", F.col("__r") - 1)
    pick = F.when(F.col("__r") < floor * k, F.col("__r") % k).otherwise(F.pmod(F.xxhash64(F.lit(str(seed)), F.col(key)), F.lit(k)))
    return ranked.withColumn(name, F.element_at(F.array(*[F.lit(v) for v in values]), (pick + 1).cast("int"))).drop("__r")


def covered(orders: DataFrame, key: str, parents: DataFrame, pk: str, name: str, seed: int | str) -> DataFrame:
    """Adds a foreign key: each parent once, then hashed parents. Skew of the tail is even."""
    n = parents.count()
    numbered = hash_rank(parents.select(pk), [], seeded(seed, pk), [pk], "__q").select(F.col(pk).alias(name), (F.col("__q") - 1).alias("__p"))
    ranked = hash_rank(orders, [], seeded(f"{seed}o", key), [key], "__o").withColumn("__o", F.col("__o") - 1)
    placed = ranked.withColumn("__p", F.when(F.col("__o") < n, F.col("__o")).otherwise(F.pmod(F.xxhash64(F.lit(str(seed)), F.col(key)), F.lit(n))))
    return placed.join(numbered, "__p").drop("__p", "__o")


def shop(spark: SparkSession, c: ShopConfig = ShopConfig(), cities: Sequence[str] = ("hoofom", "baihen", "triton"), tiers: Sequence[str] = ("basic", "plus", "prime"), categories: Sequence[str] = ("lighting", "seating", "cookware"), states: Sequence[str] = ("open", "packed", "sent", "void")) -> dict[str, DataFrame]:
    """customers, items, orders. ValueError when the configuration cannot be met."""
    if c.problems():
        raise ValueError("; ".join(c.problems()))
    s = c.seed
    cust = sample_ids(spark, *c.customer_ids, c.customers, s, "customer_id")
    cust = balanced(balanced(cust, "customer_id", cities, c.floor, "city", f"{s}c"), "customer_id", tiers, c.floor, "membership", f"{s}m")
    item = balanced(sample_ids(spark, *c.item_ids, c.items, s, "item_id"), "item_id", categories, c.floor, "category", f"{s}k")
    unit = lambda key, salt: F.pmod(F.xxhash64(F.lit(f"{s}{salt}"), F.col(key)), F.lit(1_000_000)) / 1_000_000
    item = item.withColumn("price", F.round(1 + unit("item_id", "p") * 198.99, 2)).withColumn("stock", F.when(unit("item_id", "z") < 0.08, 0).otherwise(F.floor(unit("item_id", "s") * 100) + 1).cast("long"))
    order = covered(sample_ids(spark, *c.order_ids, c.orders, s, "order_id"), "order_id", cust, "customer_id", "customer_id", f"{s}fc")
    order = covered(order, "order_id", item, "item_id", "item_id", f"{s}fi")
    order = balanced(order, "order_id", states, c.floor, "status", f"{s}st").withColumn("quantity", (F.floor(unit("order_id", "q") * 10) + 1).cast("long"))
    order = order.withColumn("order_date", F.date_format(F.date_add(F.lit("2025-01-01"), F.floor(unit("order_id", "d") * 730).cast("int")), "yyyy-MM-dd"))
    return {"customers": cust, "items": item, "orders": order}


def holdout(df: DataFrame, key: str, n_rows: int, n_ids: int, seed: int | str) -> DataFrame:
    """(key, tier): n_rows rows held out whole, and n_ids others by id only."""
    ranked = hash_rank(df.select(key), [], seeded(seed, key), [key], "r", F.lit(n_rows + n_ids))
    return ranked.where(F.col("r") <= n_rows + n_ids).select(key, F.when(F.col("r") <= n_rows, "row").otherwise("id_only").alias("tier"))


def held_dates(orders: DataFrame, share: float, seed: int | str) -> DataFrame:
    """(order_date): the share of the different dates that is held out, by seeded hash, half-even."""
    days = orders.where("order_date is not null").select("order_date").distinct()
    n = round(days.count() * share)
    return hash_rank(days, [], seeded(seed, "order_date"), ["order_date"], "r", F.lit(n)).where(F.col("r") <= n).select("order_date")


def product_pool(df: DataFrame, column: str) -> DataFrame:
    """Two-word names that do not occur yet, from the first and second words that do."""
    parts = df.where(F.col(column).isNotNull()).select(F.split_part(column, F.lit(" "), F.lit(1)).alias("a"), F.split_part(column, F.lit(" "), F.lit(2)).alias("b"))
    names = product(parts.select("a").distinct(), parts.select("b").distinct()).select(F.concat_ws(" ", "a", "b").alias("name"))
    return names.join(df.select(F.col(column).alias("name")), "name", "left_anti")


def pool_problems(words: Sequence[str]) -> list[str]:
    """Faults of a word pool: empty, repeated, or not of small ASCII letters."""
    out = [] if words else ["empty"]
    if len(set(words)) < len(words):
        out.append("repeated words")
    return out + [f"not small letters: {w}" for w in words if not (w.isascii() and w.isalpha() and w.islower())]
