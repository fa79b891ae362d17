"""A property graph over a folder of Parquet tables with customers, orders, parts, documents and events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import PropertyGraph, node_id
from ..schema import EdgeType, NodeType, Property, Registry

SPACES = {n: i for i, n in enumerate(("Customer", "Order", "Part", "Supplier", "Nation", "Region", "Document", "Page", "Event", "Turn"), 1)}


class LazyTables(dict):
    """Tables by name; a function is called at first use, so unused tables are never opened."""

    def __getitem__(self, name: str) -> DataFrame:
        value = super().__getitem__(name)
        if callable(value) and not isinstance(value, DataFrame):
            value = value()
            self[name] = value
        return value

    def values(self):
        return [self[k] for k in self]

    def items(self):
        return [(k, self[k]) for k in self]


class TableGraph(PropertyGraph):
    def __init__(self, spark: SparkSession, registry: Registry, nodes: dict[str, Callable], edges: dict[str, Callable]):
        super().__init__(spark, registry, {}, {})
        self.node_tables, self.edge_tables = LazyTables(nodes), LazyTables(edges)


def registry() -> Registry:
    plain = [NodeType(n) for n in SPACES if n not in ("Customer", "Order", "Document")]
    return Registry().add(
        *plain,
        NodeType("Customer", properties=(Property("c_custkey", key=True), Property("c_name", required=True))),
        NodeType("VipCustomer", parent="Customer", where="c_acctbal > 8000"),
        NodeType("Order", properties=(Property("o_orderkey", key=True),)),
        NodeType("UrgentOrder", parent="Order", where="o_orderpriority = '1-URGENT'"),
        NodeType("Document", properties=(Property("doc_id", key=True), Property("lang", search=False), Property("source", search=False))),
        EdgeType("PLACED", "Customer", "Order"),
        EdgeType("PLACED_URGENT", "Customer", "UrgentOrder", parent="PLACED", where="priority = '1-URGENT'"),
        EdgeType("CONTAINS", "Order", "Part"), EdgeType("SUPPLIED_BY", "Order", "Supplier"),
        EdgeType("LIVES_IN", "Customer", "Nation"), EdgeType("BASED_IN", "Supplier", "Nation"), EdgeType("PART_OF", "Nation", "Region"),
        EdgeType("NEXT_TURN", "Turn", "Turn"), EdgeType("NEXT_EVENT", "Event", "Event"), EdgeType("REFERS", "Customer", "Customer"), EdgeType("BORDERS", "Nation", "Nation"),
    )


#: Bits of a turn's key below the conversation's.
TURN_BITS = 18
#: Bits of a row's place below its file's number; a listing of files beyond ``MOST_FILES`` is an error.
ROW_BITS, MOST_FILES = 40, 1 << 16


def turn_key() -> Column:
    """Conversation and turn as one number; a turn beyond its bits is an error."""
    turn = F.col("turn").cast("long")
    fits = turn.between(0, (1 << TURN_BITS) - 1) | turn.isNull()
    return F.when(fits, F.col("conv_id").cast("long") * (1 << TURN_BITS) + turn).otherwise(F.raise_error(F.lit(f"a turn needs more than {TURN_BITS} bits")).cast("long"))


def row_number(df: DataFrame) -> Column:
    """Identity of a row of files: the file's place in the listing, and the row's place in the file. Equal rows differ."""
    files = sorted(df.inputFiles())
    if len(files) > MOST_FILES:
        raise ValueError(f"a table of more than {MOST_FILES} files needs a key of its own")
    if len(files) < 2:
        return F.col("_metadata.row_index")
    number = F.create_map(*[x for i, f in enumerate(files) for x in (F.lit(f), F.lit(i))])
    return number[F.col("_metadata.file_path")].cast("long") * (1 << ROW_BITS) + F.col("_metadata.row_index")


def load_graph(spark: SparkSession, folder: str) -> PropertyGraph:
    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}.parquet")

    def nodes(label: str, name: str, key: str, labels=None):
        def build():
            held = labels if labels is not None else F.array(F.lit(label))
            df = table(name)
            return df.select(node_id(SPACES[label], F.col(key)).alias("_nid"), held.alias("_labels"), *df.columns)

        return build

    def turns():
        df = table("conversations")
        return df.select(node_id(SPACES["Turn"], turn_key()).alias("_nid"), F.array(F.lit("Turn")).alias("_labels"), *df.columns)

    def edges(kind: str, name: str, source: tuple[str, str], target: tuple[str, str], properties: dict[str, str] | None = None, key: str | None = None):
        def build():
            df = table(name)
            eid = row_number(df) if key is None else F.col(key).cast("long")
            kept = [F.col(c).alias(p) for p, c in (properties or {}).items()]
            return df.select(
                eid.alias("_eid"), F.lit(kind).alias("_type"), node_id(SPACES[source[0]], F.col(source[1])).alias("_src"),
                node_id(SPACES[target[0]], F.col(target[1])).alias("_dst"), *kept,
            )

        return build

    def placed():
        df = table("orders")
        return df.select(
            F.col("o_orderkey").alias("_eid"), F.when(F.col("o_orderpriority") == "1-URGENT", "PLACED_URGENT").otherwise("PLACED").alias("_type"),
            node_id(1, F.col("o_custkey")).alias("_src"), node_id(2, F.col("o_orderkey")).alias("_dst"), F.col("o_orderpriority").alias("priority"),
        )

    def next_turn():
        df = table("conversations").select(turn_key().alias("k"), "conv_id", "turn")
        a = df.select("k", "conv_id", (F.col("turn") + 1).alias("turn"))
        b = df.select(F.col("k").alias("n"), "conv_id", "turn")
        return a.join(b, ["conv_id", "turn"]).select(
            F.col("k").alias("_eid"), F.lit("NEXT_TURN").alias("_type"), node_id(SPACES["Turn"], F.col("k")).alias("_src"), node_id(SPACES["Turn"], F.col("n")).alias("_dst")
        )

    def next_event():
        """Windows hold one user's day; the last event of a day is followed by the first of the user's next day."""
        df = table("events").select("event_id", "user_id", "ts", F.coalesce(F.to_date("ts"), F.lit("0001-01-01").cast("date")).alias("day"))
        inside = Window.partitionBy("user_id", "day").orderBy("ts", "event_id")
        df = df.select("event_id", "user_id", "day", F.lead("event_id").over(inside).alias("n"))
        days = table("events").groupBy("user_id", F.coalesce(F.to_date("ts"), F.lit("0001-01-01").cast("date")).alias("day")).agg(F.min(F.struct("ts", "event_id")).alias("first"))
        days = days.select(F.col("user_id").alias("u"), F.col("day").alias("d"), F.lead("first.event_id").over(Window.partitionBy("user_id").orderBy("day")).alias("after"))
        df = df.join(days, df["user_id"].eqNullSafe(days["u"]) & (F.col("day") == F.col("d")))
        df = df.select("event_id", F.coalesce("n", "after").alias("n")).where(F.col("n").isNotNull())
        return df.select(F.col("event_id").alias("_eid"), F.lit("NEXT_EVENT").alias("_type"), node_id(9, F.col("event_id")).alias("_src"), node_id(9, F.col("n")).alias("_dst"))

    def refers():
        df = table("customer").select(F.col("c_custkey").alias("k"))
        n = F.lit(df.count())
        k = F.col("k")
        arms = [
            (F.lit(True), 0, (k * 7 + 3) % n, (k * 13) % 100), (k % 2 == 0, 1, (k * 11 + 5) % n, (k * 17 + 1) % 100),
            (k % 10 == 0, 2, (k * 7 + 3) % n, (k * 19 + 2) % 100), (k % 50 == 0, 3, k, (k * 23 + 3) % 100),
        ]
        rows = F.array_compact(F.array(*[F.when(c, F.struct((k * 10 + i).alias("eid"), d.alias("dst"), w.alias("weight"))) for c, i, d, w in arms]))
        df = df.select("k", F.explode(rows).alias("e"))
        return df.select(F.col("e.eid").alias("_eid"), F.lit("REFERS").alias("_type"), node_id(1, k).alias("_src"), node_id(1, F.col("e.dst")).alias("_dst"), F.col("e.weight").alias("weight"))

    vip = F.when(F.col("c_acctbal") > 8000, F.array(F.lit("Customer"), F.lit("VipCustomer"))).otherwise(F.array(F.lit("Customer")))
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", F.array(F.lit("Order"), F.lit("UrgentOrder"))).otherwise(F.array(F.lit("Order")))
    line = {"quantity": "l_quantity", "discount": "l_discount", "price": "l_extendedprice"}
    return TableGraph(
        spark, registry(),
        {
            "Customer": nodes("Customer", "customer", "c_custkey", vip), "Order": nodes("Order", "orders", "o_orderkey", urgent),
            "Part": nodes("Part", "part", "p_partkey"), "Supplier": nodes("Supplier", "supplier", "s_suppkey"),
            "Nation": nodes("Nation", "nation", "n_nationkey"), "Region": nodes("Region", "region", "r_regionkey"),
            "Document": nodes("Document", "documents", "doc_id"), "Page": nodes("Page", "pages", "page_id"),
            "Event": nodes("Event", "events", "event_id"), "Turn": turns,
        },
        {
            "PLACED": placed, "CONTAINS": edges("CONTAINS", "lineitem", ("Order", "l_orderkey"), ("Part", "l_partkey"), line),
            "SUPPLIED_BY": edges("SUPPLIED_BY", "lineitem", ("Order", "l_orderkey"), ("Supplier", "l_suppkey"), line),
            "LIVES_IN": edges("LIVES_IN", "customer", ("Customer", "c_custkey"), ("Nation", "c_nationkey"), key="c_custkey"),
            "BASED_IN": edges("BASED_IN", "supplier", ("Supplier", "s_suppkey"), ("Nation", "s_nationkey"), key="s_suppkey"),
            "PART_OF": edges("PART_OF", "nation", ("Nation", "n_nationkey"), ("Region", "n_regionkey"), key="n_nationkey"),
            "NEXT_TURN": next_turn, "NEXT_EVENT": next_event, "REFERS": refers,
        },
    )
