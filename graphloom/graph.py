"""The property graph: node and relationship tables behind a typed query surface.

A node table has ``_nid`` (identity, private), ``_labels`` and its properties; a
relationship table has ``_eid``, ``_type``, ``_src``, ``_dst`` (physical ends) and
its properties. A graph is an immutable snapshot of such tables; every query is
a DataFrame plan over it, so filters, columns and joins are Catalyst's to
arrange, and scans are pruned to the types that can match.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import GraphQueryError
from .functions.search import matches_all, query_terms
from .schema import Registry

STRUCTURAL_NODE = ("_nid", "_labels")
STRUCTURAL_EDGE = ("_eid", "_type", "_src", "_dst")


def node_id(space: int, key: Column) -> Column:
    """Identity over all types: the type's number above 48 bits of key; a key beyond them is an error."""
    key = key.cast("long")
    fits = key.between(0, (1 << 48) - 1) | key.isNull()
    return F.when(fits, F.lit(space << 48) + key).otherwise(F.raise_error(F.lit("a node's key needs more than 48 bits")).cast("long"))


class PropertyGraph:
    def __init__(self, spark: SparkSession, registry: Registry, nodes: Mapping[str, DataFrame], edges: Mapping[str, DataFrame]):
        self.spark, self.registry = spark, registry
        self.node_tables, self.edge_tables = dict(nodes), dict(edges)
        #: The next free ids by type, and how many changes a table has had since it was last written.
        self.counters: dict[tuple[str, str], int] = {}
        self.pending: dict[tuple[str, str], int] = {}

    def replaced(self, nodes: Mapping[str, DataFrame] | None = None, edges: Mapping[str, DataFrame] | None = None) -> PropertyGraph:
        """A snapshot with some tables replaced."""
        out = PropertyGraph(self.spark, self.registry, {}, {})
        out.node_tables, out.edge_tables = self.node_tables | dict(nodes or {}), self.edge_tables | dict(edges or {})
        if type(self.node_tables) is not dict:  # tables that open at first use stay so
            out.node_tables, out.edge_tables = type(self.node_tables)(out.node_tables), type(self.edge_tables)(out.edge_tables)
        out.counters, out.pending = dict(self.counters), dict(self.pending)
        return out

    def owner_of_type(self, kind: str) -> str:
        """The relationship table that holds a concrete type."""
        return self.registry.edge_owner(kind) if kind in self.registry.edges else kind

    def owner_of_label(self, label: str) -> str:
        return self.registry.owner(label) if label in self.registry.nodes else label

    def edge_table_names(self, kind: str | None) -> list[str]:
        """The tables in which relationships of the type can be."""
        reg = self.registry
        names = list(self.edge_tables) if kind is None else dict.fromkeys(reg.edge_owner(k) for k in reg.compatible_types(kind))
        return [n for n in names if n in self.edge_tables]

    # tables

    def node_df(self, label: str) -> DataFrame:
        """All nodes of the type or of one that derives from it, in the base type's scope; reads no other table."""
        reg = self.registry
        owner = reg.owner(label)
        parts = []
        conditions, at = [], label
        while reg.node(at).where is not None:
            conditions.append(reg.node(at).where)
            at = reg.node(at).parent
        if owner in self.node_tables:
            df = self.node_tables[owner]
            for c in conditions:
                df = df.filter(c)
            parts.append(df)
        for sub in reg.compatible_labels(label)[1:]:
            if reg.owner(sub) == sub and sub in self.node_tables:
                parts.append(self.node_tables[sub])
        if not parts:
            raise GraphQueryError(f"no table holds nodes of type {label}")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def edge_df(self, kind: str | None) -> DataFrame:
        """All relationships of the type or of one that derives from it; None: of any type."""
        reg = self.registry
        if kind is None:
            parts = list(self.edge_tables.values())
        else:
            owner, conditions, at = reg.edge_owner(kind), [], kind
            while reg.edge(at).where is not None:
                conditions.append(reg.edge(at).where)
                at = reg.edge(at).parent
            parts = []
            if owner in self.edge_tables:
                df = self.edge_tables[owner]
                for c in conditions:
                    df = df.filter(c)
                parts.append(df)
            parts += [self.edge_tables[s] for s in reg.compatible_types(kind)[1:] if reg.edge_owner(s) == s and s in self.edge_tables]
        if not parts:
            raise GraphQueryError(f"no table holds relationships of type {kind}")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    @staticmethod
    def _bag(df: DataFrame, structural: tuple[str, ...]) -> Column:
        names = [c for c, t in df.dtypes if c not in structural]
        if not names:
            return F.create_map().cast("map<string,string>")
        text = [F.col(c).cast("string") if not t.startswith(("array", "map", "struct")) else F.to_json(c) for c, t in df.dtypes if c not in structural]
        pairs = [F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in zip(names, text, strict=True)]
        return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))

    def dynamic_node_df(self) -> DataFrame:
        parts = [df.select(*STRUCTURAL_NODE, self._bag(df, STRUCTURAL_NODE).alias("props")) for df in self.node_tables.values()]
        return reduce(DataFrame.unionByName, parts)

    def dynamic_edge_df(self) -> DataFrame:
        parts = [df.select(*STRUCTURAL_EDGE, self._bag(df, STRUCTURAL_EDGE).alias("props")) for df in self.edge_tables.values()]
        return reduce(DataFrame.unionByName, parts)

    # query roots

    def nodes(self, label: str):
        from .operators.query import GraphQuery

        return GraphQuery.node_root(self, self.node_df(label), label)

    def relationships(self, kind: str):
        from .operators.query import GraphQuery

        return GraphQuery.edge_root(self, self.edge_df(kind), kind)

    def dynamic_nodes(self):
        from .operators.query import GraphQuery

        return GraphQuery.node_root(self, self.dynamic_node_df(), None)

    def dynamic_relationships(self):
        from .operators.query import GraphQuery

        return GraphQuery.edge_root(self, self.dynamic_edge_df(), None)

    def search_columns(self, df: DataFrame, rules: dict) -> list[str]:
        return [c for c, t in df.dtypes if t == "string" and not c.startswith("_") and (c not in rules or rules[c].search)]

    def search_nodes(self, query: str, label: str | None = None):
        if label is not None:
            return self.nodes(label).search(query)
        return self.dynamic_nodes().search(query)

    def search_relationships(self, query: str, kind: str | None = None):
        if kind is not None:
            return self.relationships(kind).search(query)
        return self.dynamic_relationships().search(query)

    def search(self, query: str):
        """Nodes and relationships at once; the result cannot be traversed."""
        from .operators.query import GraphQuery

        terms = query_terms(query)

        def hits(tables: dict, structural: tuple, entity: str, identity: str, rules) -> list[DataFrame]:
            out = []
            for name, df in tables.items():
                columns = self.search_columns(df, rules(name))
                if columns:
                    found = df.filter(matches_all([F.col(c) for c in columns], terms))
                    kinds = F.col("_labels") if entity == "node" else F.array("_type")
                    out.append(found.select(F.lit(entity).alias("kind"), F.col(identity).alias("_id"), kinds.alias("_labels"), self._bag(df, structural).alias("props")))
            return out

        parts = hits(self.node_tables, STRUCTURAL_NODE, "node", "_nid", self.registry.node_rules)
        parts += hits(self.edge_tables, STRUCTURAL_EDGE, "relationship", "_eid", self.registry.edge_rules)
        return GraphQuery.mixed_root(self, reduce(DataFrame.unionByName, parts))
