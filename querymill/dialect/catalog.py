"""Tables of the dialect and what each kind of column allows. Rules are data: another schema is another Catalog."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# Fixed values of the dialect: operators by kind of column.
OPERATORS = {
    "id": ("=", "IN"),
    "name": ("=", "LIKE", "IN"),
    "cat": ("=", "!=", "IN"),
    "num": ("=", "<", ">", "<=", ">=", "BETWEEN", "IN"),
    "date": ("=", "<", ">", "<=", ">=", "BETWEEN"),
}


@dataclass(frozen=True)
class Table:
    """columns: name -> kind, in the order that conditions are written in. The first column is the primary key."""

    name: str
    columns: dict[str, str]
    source: str
    ident: str = ""
    own_id: str = ""
    floats: frozenset[str] = frozenset()
    unique: frozenset[str] = frozenset()
    groups: tuple[str, ...] = ()
    timestamps: frozenset[str] = frozenset()

    @property
    def key(self) -> str:
        return next(iter(self.columns))

    def operators(self, column: str) -> tuple[str, ...]:
        ops = OPERATORS[self.columns[column]]
        return tuple(o for o in ops if o != "IN" or column not in self.floats)

    def is_text(self, column: str) -> bool:
        return self.columns[column] in ("name", "cat", "date")

    def orderable(self, column: str) -> bool:
        return self.columns.get(column) in ("num", "date") or column == self.key

    def numbers(self) -> tuple[str, ...]:
        return tuple(c for c, k in self.columns.items() if k == "num")


@dataclass(frozen=True)
class Catalog:
    tables: dict[str, Table] = field(default_factory=dict)

    def load(self, spark: SparkSession, directory: str, table: str) -> DataFrame:
        return spark.read.parquet(f"{directory}/{self.tables[table].source}.parquet")


def _of(*tables: Table) -> Catalog:
    return Catalog({t.name: t for t in tables})


#: The shop: three tables; the file of `orders` is shop_orders.
SHOP = _of(
    Table(
        "customers", {"customer_id": "id", "name": "name", "city": "cat", "membership": "cat"}, "customers", "name", "customer_id",
        unique=frozenset({"customer_id", "name"}), groups=("city", "membership"),
    ),
    Table(
        "items", {"item_id": "id", "item_name": "name", "category": "cat", "price": "num", "stock": "num"}, "items", "item_name", "item_id",
        floats=frozenset({"price"}), unique=frozenset({"item_id", "item_name"}), groups=("category",),
    ),
    Table(
        "orders", {"order_id": "id", "customer_id": "id", "item_id": "id", "quantity": "num", "status": "cat", "order_date": "date"}, "shop_orders", "order_id", "",
        unique=frozenset({"order_id"}), groups=("customer_id", "item_id", "status", "order_date"),
    ),
)

#: The same dialect over a star schema; the first column is the tie-break and need not be unique there.
STAR = _of(
    Table("customer", {"c_custkey": "id", "c_name": "name", "c_nationkey": "id", "c_acctbal": "num", "c_mktsegment": "cat"}, "customer", "c_name", "c_custkey",
          floats=frozenset({"c_acctbal"}), unique=frozenset({"c_custkey", "c_name"}), groups=("c_mktsegment", "c_nationkey")),
    Table("part", {"p_partkey": "id", "p_name": "name", "p_brand": "cat", "p_type": "cat", "p_size": "num", "p_retailprice": "num"}, "part", "p_name", "p_partkey",
          floats=frozenset({"p_retailprice"}), unique=frozenset({"p_partkey"}), groups=("p_brand", "p_type", "p_size")),
    Table("orders", {"o_orderkey": "id", "o_custkey": "id", "o_orderstatus": "cat", "o_totalprice": "num", "o_orderdate": "date", "o_orderpriority": "cat"}, "orders", "o_orderkey", "",
          floats=frozenset({"o_totalprice"}), unique=frozenset({"o_orderkey"}), groups=("o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate"), timestamps=frozenset({"o_orderdate"})),
    Table("lineitem", {"l_orderkey": "id", "l_partkey": "id", "l_suppkey": "id", "l_linenumber": "num", "l_quantity": "num", "l_extendedprice": "num", "l_discount": "num", "l_returnflag": "cat", "l_linestatus": "cat", "l_shipdate": "date"}, "lineitem", "l_orderkey", "",
          floats=frozenset({"l_extendedprice", "l_discount", "l_quantity"}), groups=("l_returnflag", "l_linestatus", "l_suppkey", "l_shipdate"), timestamps=frozenset({"l_shipdate"})),
)
