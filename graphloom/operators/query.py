"""The fluent query: an immutable wrapper of a DataFrame plan and what is in scope.

Operators keep a fixed order of meaning whatever their place in the chain:
filters, then projection, then distinct, then ordering, then one window of
offset and limit. What follows a window works on the window's rows. Shapes
outside the grammar raise ``GraphQueryError`` while the query is built.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import CardinalityError, EmptyResultError, GraphQueryError
from ..functions.search import matches_all, query_terms
from . import group, traverse
from .refs import EntityRef, PathRef, RowRef, SegmentRef, column

#: Tasks for each core, and parts of a key's inner rows, of a join of two small tables.
SHARES, PARTS = 4, 256

DIRECTIONS = ("out", "in", "both")


def _in_tiles(left: DataFrame, right: DataFrame, pairs: list[tuple[Column, Column]], identity: Column) -> DataFrame:
    """Inner join of two small tables, of which few keys may make very many rows.

    The inner rows of a key are in parts. Tasks share the keys' parts; of each, every outer row stands with the
    part's rows in turn. So all tasks work, and columnar files hold the same few rows again and again, in few bytes.
    """
    part = F.pmod(F.xxhash64(identity), F.lit(PARTS))
    names = [f"__k{i}" for i in range(len(pairs))]
    outer = reduce(and_, [x == F.col(k) for k, (x, _) in zip(names, pairs, strict=True)])
    parts = right.select(*[y.alias(k) for k, (_, y) in zip(names, pairs, strict=True)], part.alias("__p")).distinct()
    met = left.select(*[x.alias(f"__o{i}") for i, (x, _) in enumerate(pairs)]).distinct()
    parts = parts.join(F.broadcast(met), reduce(and_, [F.col(f"__o{i}") == F.col(k) for i, k in enumerate(names)]), "left_semi")
    parts = parts.repartitionByRange(SHARES * left.sparkSession.sparkContext.defaultParallelism, *names, "__p").sortWithinPartitions(*names, "__p")
    inner = reduce(and_, [F.col(k) == y for k, (_, y) in zip(names, pairs, strict=True)], F.col("__p") == F.col("__part"))
    rows = parts.join(F.broadcast(left), outer).join(F.broadcast(right.withColumn("__part", part)), inner)
    return rows.select(*[F.col(f"`{c}`") for c in (*left.columns, *right.columns)])


@dataclass(frozen=True)
class GraphQuery:
    graph: object
    df: DataFrame
    kind: str  # node, edge, segment, path, optional, value, row, mixed, set
    aliases: tuple[str, ...] = ()
    types: tuple[str | None, ...] = ()
    orders: tuple[tuple[str, bool], ...] = ()
    offset: int = 0
    limit: int | None = None
    windows: int = 0
    stage: str = "root"  # root, traversed, projected: what may still follow
    bare: bool = True
    deduplicated: bool = False
    set_kind: str | None = None
    degrees: tuple = ()
    path_closed: bool = False

    # roots

    @classmethod
    def node_root(cls, graph, df: DataFrame, label: str | None) -> GraphQuery:
        return cls(graph, df.select(*[F.col(f"`{c}`").alias(column("n0", c)) for c in df.columns]), "node", ("n0",), (label,))

    @classmethod
    def edge_root(cls, graph, df: DataFrame, kind: str | None) -> GraphQuery:
        return cls(graph, df.select(*[F.col(f"`{c}`").alias(column("r0", c)) for c in df.columns]), "edge", ("r0",), (kind,))

    @classmethod
    def mixed_root(cls, graph, df: DataFrame) -> GraphQuery:
        return cls(graph, df, "mixed")

    # scope

    @property
    def ref(self):
        if self.kind in ("node", "edge"):
            return EntityRef(self, self.aliases[-1])
        if self.kind in ("segment", "optional"):
            return SegmentRef(self)
        if self.kind == "path":
            return PathRef(self)
        if self.kind == "value":
            return F.col("value")
        return RowRef(self)

    def _check_open(self, what: str) -> None:
        if self.set_kind is not None:
            raise GraphQueryError(f"{what} may not follow a set operation")

    def _close_window(self, what: str) -> GraphQuery:
        """The window's rows as a plain source."""
        if self.limit is None and not self.offset:
            return self
        if self.windows > 1:
            raise GraphQueryError(f"{what} may not follow a second paging window")
        return replace(self, df=self._windowed(), orders=self.orders, offset=0, limit=None, bare=False)

    def _ordered(self) -> DataFrame:
        if not self.orders:
            return self.df
        return self.df.orderBy(*[F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_first() for c, down in self.orders])

    def _windowed(self) -> DataFrame:
        df = self._ordered()
        if self.offset:
            df = df.offset(self.offset)
        if self.limit is not None:
            df = df.limit(self.limit)
        return df

    # filters

    def where(self, predicate: Callable) -> GraphQuery:
        self._check_open("where")
        if self.kind == "optional":
            raise GraphQueryError("where may not follow an optional traversal")
        if self.kind == "path" and self.path_closed:
            raise GraphQueryError("where on a path must come before paging and projection")
        q = self._close_window("where")
        return replace(q, df=q.df.filter(predicate(q.ref)), bare=False)

    def of_label(self, label: str) -> GraphQuery:
        return self.of_labels("any", [label])

    def of_labels(self, mode: str, labels: list[str]) -> GraphQuery:
        self._check_root("a label filter")
        if self.kind != "node":
            raise GraphQueryError("a label filter needs nodes")
        if mode not in ("any", "all"):
            raise GraphQueryError(f"unknown label mode {mode}")
        if not labels:
            return self
        held, wanted = self.ref.labels, F.array(*[F.lit(x) for x in dict.fromkeys(labels)])
        test = F.arrays_overlap(held, wanted) if mode == "any" else F.size(F.array_intersect(held, wanted)) == len(set(labels))
        return replace(self, df=self.df.filter(test), bare=False)

    def _check_root(self, what: str) -> None:
        self._check_open(what)
        if self.stage != "root" or self.windows:
            raise GraphQueryError(f"{what} may not follow a projection, paging or traversal")

    def where_has_relationship(self, kind: str | None, direction: str = "out", where: Callable | None = None, node: str | None = None) -> GraphQuery:
        """Nodes with a fitting incident relationship; with ``node``, whose other end is of that type."""
        self._check_root("where_has_relationship")
        if self.kind != "node":
            raise GraphQueryError("where_has_relationship needs nodes")
        ends = traverse.oriented(self.graph, kind, direction, where)
        if node is not None:
            there = self.graph.node_df(node).select(F.col("_nid").alias("__to"))
            ends = ends.join(there, "__to", "left_semi")
        ends = ends.select("__from")
        nid = F.col(column(self.aliases[-1], "_nid"))
        return replace(self, df=self.df.join(ends, nid == F.col("__from"), "left_semi"), bare=False)

    def search(self, query: str) -> GraphQuery:
        """Rows whose entity in scope holds all terms of the query."""
        self._check_open("search")
        if self.kind not in ("node", "edge"):
            raise GraphQueryError("search needs a node or relationship in scope")
        q, alias, kind = self._close_window("search"), self.aliases[-1], self.types[-1]
        terms = query_terms(query)
        props = column(alias, "props")
        if kind is None and props in q.df.columns:
            columns = [F.array_join(F.map_values(F.col(props)), " ")]
        else:
            rules = (self.graph.registry.node_rules if self.kind == "node" else self.graph.registry.edge_rules)(kind) if kind else {}
            start = len(alias) + 2
            plain = [(c[start:], t) for c, t in q.df.dtypes if c.startswith(alias + "__")]
            columns = [F.col(column(alias, c)) for c, t in plain if t == "string" and not c.startswith("_") and (c not in rules or rules[c].search)]
        return replace(q, df=q.df.filter(matches_all(columns, terms)), bare=False)

    # projection

    def _degree(self, alias: str, kind: str | None, direction: str) -> Column:
        if direction not in DIRECTIONS:
            raise GraphQueryError(f"unknown direction {direction}")
        name = f"__degree_{alias}_{kind}_{direction}"
        asked = getattr(self, "_asked", None)
        if asked is None:
            raise GraphQueryError("count_relationships is for projections")
        asked[name] = (alias, kind, direction)
        return F.col(f"`{name}`")

    def select(self, shape: Callable, strict: bool = False) -> GraphQuery:
        """A column, or a dict of columns. ``strict``: a null in a single value is an error."""
        self._check_open("select")
        if self.kind == "set":
            raise GraphQueryError("select may not follow a set operation")
        asked: dict = {}
        object.__setattr__(self, "_asked", asked)
        try:
            out = shape(self.ref) if self.kind != "optional" else shape(self.ref.start, self.ref.end)
        finally:
            object.__delattr__(self, "_asked")
        df = self.df
        for name, (alias, kind, direction) in asked.items():
            df = traverse.with_degree(self.graph, df, alias, kind, direction, name)
        hidden = [F.col(c) for c, _ in self.orders]
        if isinstance(out, EntityRef):
            return replace(self, df=df, kind="node" if out._alias.startswith("n") else "edge", aliases=(out._alias,), types=(self._type_of(out._alias),), stage="traversed" if self.stage != "root" else self.stage, bare=False)
        if isinstance(out, dict):
            columns = []
            for k, v in out.items():
                if isinstance(v, EntityRef):
                    v = F.when(v.identity.isNotNull(), F.struct(*[F.col(f"`{c}`").alias(c.split("__", 1)[1]) for c in v.columns()]))
                columns.append((v if isinstance(v, Column) else F.lit(v)).alias(k))
            return replace(self, df=df.select(*columns, *hidden), kind="row", aliases=(), types=(), stage="projected", bare=False, path_closed=True)
        value = out if isinstance(out, Column) else F.lit(out)
        if strict:
            value = F.when(value.isNull(), F.raise_error(F.lit("null where a value is required"))).otherwise(value)
        return replace(self, df=df.select(value.alias("value"), *hidden), kind="value", aliases=(), types=(), stage="projected", bare=False, path_closed=True)

    def _type_of(self, alias: str) -> str | None:
        return dict(zip(self.aliases, self.types, strict=True)).get(alias)

    def select_many(self, *_):
        raise GraphQueryError("select_many is not supported")

    # ordering, paging, distinct

    def order_by(self, key: Callable, descending: bool = False) -> GraphQuery:
        return self._order(key, descending, first=True)

    def order_by_descending(self, key: Callable) -> GraphQuery:
        return self._order(key, True, first=True)

    def then_by(self, key: Callable, descending: bool = False) -> GraphQuery:
        if not self.orders:
            raise GraphQueryError("then_by needs an ordering before it")
        return self._order(key, descending, first=False)

    def then_by_descending(self, key: Callable) -> GraphQuery:
        return self.then_by(key, True)

    def _order(self, key: Callable, descending: bool, first: bool) -> GraphQuery:
        self._check_open("ordering")
        if self.kind in ("optional", "path"):
            raise GraphQueryError(f"ordering may not follow {'an optional traversal' if self.kind == 'optional' else 'a path operator'}")
        q = self._close_window("ordering")
        value = key(q.ref)
        if not isinstance(value, Column):
            raise GraphQueryError("whole entities cannot be ordered")
        keep = () if first else q.orders
        name = f"__o{len(keep)}"
        df = q.df.drop(*[c for c, _ in q.orders]) if first else q.df
        return replace(q, df=df.withColumn(name, value), orders=(*keep, (name, descending)))

    def skip(self, n: int) -> GraphQuery:
        self._check_open("skip")
        n = max(0, n)
        if self.limit is not None:
            n_in = min(n, self.limit)
            return replace(self, offset=self.offset + n_in, limit=self.limit - n_in, bare=False, path_closed=True)
        return self._window(offset=self.offset + n)

    def take(self, n: int) -> GraphQuery:
        self._check_open("take")
        n = max(0, n)
        return self._window(limit=n if self.limit is None else min(n, self.limit))

    def _window(self, **change) -> GraphQuery:
        opened = self.limit is not None or self.offset
        return replace(self, windows=self.windows + (not opened), bare=False, path_closed=True, **change)

    def distinct(self) -> GraphQuery:
        """Entities by identity, values by value."""
        self._check_open("distinct")
        if self.kind in ("optional", "path"):
            raise GraphQueryError(f"distinct may not follow {'an optional traversal' if self.kind == 'optional' else 'a path operator'}")
        q = self._close_window("distinct")
        return replace(q, df=q.df.dropDuplicates(q._identity()), bare=False, deduplicated=True)

    def _identity(self) -> list[str]:
        if self.kind == "node":
            return [column(self.aliases[-1], "_nid")]
        if self.kind == "edge":  # an id is unique within its type
            return [column(self.aliases[-1], c) for c in ("_type", "_eid")]
        if self.kind == "segment":
            return [column(self.aliases[0], "_nid"), *[column(self.aliases[1], c) for c in ("_type", "_eid")], column(self.aliases[2], "_nid")]
        if self.kind == "mixed":
            return ["kind", "_labels", "_id"]
        return self._visible()

    def _visible(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith("__")]

    # joins and set operations

    def join(self, inner: GraphQuery, outer_key: Callable, inner_key: Callable, result: Callable) -> GraphQuery:
        """Inner equi-join with a bare node or relationship set; null keys never match."""
        self._check_open("join")
        if not inner.bare or inner.kind not in ("node", "edge"):
            raise GraphQueryError("the inner side of a join must be a bare node or relationship set")
        if self.kind not in ("node", "edge"):
            raise GraphQueryError("the outer side of a join must be nodes or relationships")
        q = self._close_window("join")
        prefix = "nj" if inner.kind == "node" else "rj"
        right = inner.df.select(*[F.col(f"`{c}`").alias(column(prefix, c.split("__", 1)[1])) for c in inner.df.columns])
        moved = replace(inner, df=right, aliases=(prefix,))
        a, b = outer_key(q.ref), inner_key(moved.ref)
        pairs = list(zip(a, b, strict=True)) if isinstance(a, tuple) else [(a, b)]
        test = pairs[0][0] == pairs[0][1]
        for x, y in pairs[1:]:
            test = test & (x == y)
        joined = replace(q, df=q.df.join(right, test), aliases=(*q.aliases, prefix), types=(*q.types, inner.types[0]), bare=False)
        out = joined._joined(q.aliases[-1], prefix, result)
        if traverse.joins_small(out.df):
            out = replace(joined, df=_in_tiles(q.df, right, pairs, moved.ref.identity))._joined(q.aliases[-1], prefix, result)
        return out

    def _joined(self, a: str, b: str, result: Callable) -> GraphQuery:
        return replace(self, kind="row").select(lambda _: result(EntityRef(self, a), EntityRef(self, b)))

    def union(self, other: GraphQuery) -> GraphQuery:
        return self._set("union", other)

    def concat(self, other: GraphQuery) -> GraphQuery:
        return self._set("concat", other)

    def _set(self, kind: str, other: GraphQuery) -> GraphQuery:
        if self.set_kind is not None and self.set_kind != kind:
            raise GraphQueryError("union and concat may not be mixed in one chain; nest them")
        a = self if self.set_kind == kind else self._plain()
        b = other._plain()
        if a.kind != b.kind or sorted(a._bare_names()) != sorted(b._bare_names()):
            raise GraphQueryError("the operands of a set operation must have the same shape")
        right = b.df
        if a.aliases:
            renamed = {column(b.aliases[-1], n): column(a.aliases[-1], n) for n in b._bare_names()}
            right = right.select(*[F.col(f"`{x}`").alias(y) for x, y in renamed.items()])
        df = a.df.unionByName(right)
        out = replace(a, df=df, orders=(), offset=0, limit=None, set_kind=kind, bare=False)
        return replace(out, df=df.dropDuplicates(out._identity())) if kind == "union" else out

    def _plain(self) -> GraphQuery:
        """Only the columns of what is in scope, the window applied."""
        q = self
        df = q._windowed()
        keep = [c for c in df.columns if c.startswith(q.aliases[-1] + "__")] if q.kind in ("node", "edge") else q._visible()
        return replace(q, df=df.select(*[F.col(f"`{c}`") for c in keep]), orders=(), offset=0, limit=None, aliases=q.aliases[-1:], types=q.types[-1:])

    def _bare_names(self) -> list[str]:
        return [c.split("__", 1)[1] for c in self.df.columns] if self.aliases else self.df.columns

    # traversal

    def path_segments(self, kind: str | None, target: str | None, direction: str = "out", where: Callable | None = None) -> GraphQuery:
        return traverse.segments(self, kind, target, direction, where)

    def traverse(self, kind: str | None, target: str | None, min_depth: int | None = None, max_depth: int | None = None, direction: str = "out", where: Callable | None = None) -> GraphQuery:
        """The nodes reached; ``traverse(r, t, 1, 3)`` one row for each trail of one to three hops."""
        if min_depth is not None and max_depth is None:
            min_depth, max_depth = 1, min_depth
        if max_depth is None:
            q = traverse.segments(self, kind, target, direction, where)
        else:
            q = traverse.trails(self, kind, target, 1 if min_depth is None else min_depth, max_depth, direction, where, paths=False)
        return replace(q, kind="node", aliases=q.aliases[-1:], types=q.types[-1:], stage="traversed")

    def reverse_traverse(self, kind: str | None, target: str | None, where: Callable | None = None) -> GraphQuery:
        return self.traverse(kind, target, direction="in", where=where)

    def traverse_relationships(self, kind: str | None, target: str | None, direction: str = "out", where: Callable | None = None) -> GraphQuery:
        q = traverse.segments(self, kind, target, direction, where)
        return replace(q, kind="edge", aliases=q.aliases[1:2], types=q.types[1:2], stage="traversed")

    def traverse_paths(self, kind: str | None, target: str | None, min_depth: int, max_depth: int, direction: str = "out", where: Callable | None = None) -> GraphQuery:
        q = traverse.trails(self, kind, target, min_depth, max_depth, direction, where)
        return replace(q, kind="path", stage="traversed", path_closed=False)

    def shortest_path(self, kind: str | None, target: str | None, predicate: Callable | None = None, direction: str = "out", max_depth: int | None = None) -> GraphQuery:
        return traverse.shortest(self, kind, target, predicate, direction, every=False, max_depth=max_depth)

    def all_shortest_paths(self, kind: str | None, target: str | None, predicate: Callable | None = None, direction: str = "out", max_depth: int | None = None) -> GraphQuery:
        return traverse.shortest(self, kind, target, predicate, direction, every=True, max_depth=max_depth)

    def optional_traverse(self, kind: str | None, target: str | None, direction: str = "out") -> GraphQuery:
        if self.stage != "root":
            raise GraphQueryError("an optional traversal must be the only traversal")
        return traverse.segments(self, kind, target, direction, None, optional=True)

    # grouping

    def group_by(self, key: Callable, result: Callable | None = None):
        self._check_open("group_by")
        grouped = group.start(self, key)
        return grouped if result is None else grouped.select(lambda g: result(g.key, g))

    # terminals: one-row DataFrames, and driver values

    def to_df(self) -> DataFrame:
        """The result: entities as their plain columns, everything else as projected."""
        df = self._windowed()
        if self.kind in ("node", "edge"):
            alias = self.aliases[-1]
            keep = [c for c in df.columns if c.startswith(alias + "__")]
            return df.select(*[F.col(f"`{c}`").alias(c.split("__", 1)[1]) for c in keep])
        return df.select(*[F.col(f"`{c}`") for c in df.columns if not c.startswith("__")])

    def _terminal(self, what: str, predicate: Callable | None) -> GraphQuery:
        if predicate is None:
            return self
        if self.windows:
            raise GraphQueryError(f"{what} with a predicate may not follow paging")
        return self.where(predicate)

    def _aggregate(self, what: str, selector: Callable | None) -> tuple[DataFrame, Column]:
        self._check_aggregate(what)
        q = self if self.limit is not None or self.offset else replace(self, orders=())
        if selector is None:
            if self.kind == "row" and self.deduplicated:
                raise GraphQueryError(f"{what} over distinct rows of several columns")
            if self.kind != "value":
                raise GraphQueryError(f"{what} needs a single value")
            return q._windowed(), F.col("value")
        return q._windowed(), selector(self.ref)

    def _check_aggregate(self, what: str) -> None:
        self._check_open(what)
        if self.kind == "optional":
            raise GraphQueryError(f"{what} may not follow an optional traversal")
        if self.kind == "path" and what not in ("count", "any"):
            raise GraphQueryError(f"{what} may not follow a path operator")

    def count_df(self, predicate: Callable | None = None, name: str = "value") -> DataFrame:
        self._check_aggregate("count")
        q = self._terminal("count", predicate)
        q = q if q.limit is not None or q.offset else replace(q, orders=())
        return q._windowed().agg(F.count(F.lit(1)).alias(name))

    def sum_df(self, selector: Callable | None = None, name: str = "value") -> DataFrame:
        df, x = self._aggregate("sum", selector)
        return df.agg(F.coalesce(F.sum(x), F.lit(0)).alias(name))

    def average_df(self, selector: Callable | None = None, name: str = "value") -> DataFrame:
        df, x = self._aggregate("average", selector)
        return df.agg(F.avg(x).alias(name))

    def min_df(self, selector: Callable | None = None, name: str = "value") -> DataFrame:
        df, x = self._aggregate("min", selector)
        return df.agg(F.min(x).alias(name))

    def max_df(self, selector: Callable | None = None, name: str = "value") -> DataFrame:
        df, x = self._aggregate("max", selector)
        return df.agg(F.max(x).alias(name))

    def any_df(self, predicate: Callable | None = None, name: str = "value") -> DataFrame:
        self._check_aggregate("any")
        q = self._terminal("any", predicate)
        q = q if q.limit is not None or q.offset else replace(q, orders=())
        return q._windowed().limit(1).agg((F.count(F.lit(1)) > 0).alias(name))

    def all_df(self, predicate: Callable, name: str = "value") -> DataFrame:
        """True for no rows; a null predicate counts as false."""
        self._check_aggregate("all")
        if self.windows:
            raise GraphQueryError("all with a predicate may not follow paging")
        missed = self.df.filter(~F.coalesce(predicate(self.ref), F.lit(False))).limit(1)
        return missed.agg((F.count(F.lit(1)) == 0).alias(name))

    def contains_df(self, item, name: str = "value") -> DataFrame:
        df, x = self._aggregate("contains", None)
        return df.filter(x.eqNullSafe(F.lit(item))).limit(1).agg((F.count(F.lit(1)) > 0).alias(name))

    def first_df(self, predicate: Callable | None = None) -> DataFrame:
        return self._terminal("first", predicate)._limited(1).to_df()

    def last_df(self, predicate: Callable | None = None) -> DataFrame:
        if not self.orders:
            raise GraphQueryError("last needs an ordering")
        q = self._terminal("last", predicate)
        if q.limit is not None or q.offset:
            q = replace(q, df=q._windowed(), offset=0, limit=None)
        turned = []
        df = q.df
        for c, down in q.orders:
            turned.append(F.col(c).asc_nulls_first() if down else F.col(c).desc_nulls_last())
        return replace(q, df=df.orderBy(*turned).limit(1), orders=()).to_df()

    def element_at_df(self, index: int) -> DataFrame:
        if index < 0:
            raise GraphQueryError("element_at needs an index of 0 or more")
        return replace(self, offset=index, limit=1).to_df()

    def single_df(self, predicate: Callable | None = None) -> DataFrame:
        """At most two rows, enough to tell that one is not alone."""
        return self._terminal("single", predicate)._limited(2).to_df()

    def _limited(self, n: int) -> GraphQuery:
        return replace(self, limit=n if self.limit is None else min(n, self.limit))

    def count(self, predicate: Callable | None = None) -> int:
        return self.count_df(predicate).first()[0]

    long_count = count

    def sum(self, selector: Callable | None = None):
        return self.sum_df(selector).first()[0]

    def average(self, selector: Callable | None = None, nullable: bool = False):
        return self._needed(self.average_df(selector), "average", nullable)

    def min(self, selector: Callable | None = None, nullable: bool = False):
        return self._needed(self.min_df(selector), "min", nullable)

    def max(self, selector: Callable | None = None, nullable: bool = False):
        return self._needed(self.max_df(selector), "max", nullable)

    @staticmethod
    def _needed(df: DataFrame, what: str, nullable: bool):
        value = df.first()[0]
        if value is None and not nullable:
            raise EmptyResultError(f"{what} of no values")
        return value

    def any(self, predicate: Callable | None = None) -> bool:
        return self.any_df(predicate).first()[0]

    def all(self, predicate: Callable) -> bool:
        return self.all_df(predicate).first()[0]

    def contains(self, item) -> bool:
        return self.contains_df(item).first()[0]

    @staticmethod
    def _one(rows: list, what: str, default):
        if rows:
            return rows[0]
        if default:
            return None
        raise EmptyResultError(f"{what} of no rows")

    def first(self, predicate: Callable | None = None):
        return self._one(self.first_df(predicate).collect(), "first", False)

    def first_or_default(self, predicate: Callable | None = None):
        return self._one(self.first_df(predicate).collect(), "first", True)

    def last(self, predicate: Callable | None = None):
        return self._one(self.last_df(predicate).collect(), "last", False)

    def last_or_default(self, predicate: Callable | None = None):
        return self._one(self.last_df(predicate).collect(), "last", True)

    def element_at(self, index: int):
        return self._one(self.element_at_df(index).collect(), "element_at", False)

    def element_at_or_default(self, index: int):
        return self._one(self.element_at_df(index).collect(), "element_at", True)

    def single(self, predicate: Callable | None = None):
        return self._single(predicate, False)

    def single_or_default(self, predicate: Callable | None = None):
        return self._single(predicate, True)

    def _single(self, predicate, default):
        rows = self.single_df(predicate).collect()
        if len(rows) > 1:
            raise CardinalityError("single of several rows")
        return self._one(rows, "single", default)

    def to_list(self) -> list:
        rows = self.to_df().collect()
        return [r[0] for r in rows] if self.kind == "value" else rows

    to_array = to_list

    def to_dictionary(self, key: Callable, value: Callable | None = None) -> dict:
        """By a function of the result rows; a key that occurs twice is an error."""
        out = {}
        for r in self.to_list():
            k = key(r)
            if k in out:
                raise CardinalityError(f"key {k!r} occurs twice")
            out[k] = r if value is None else value(r)
        return out

    def to_lookup(self, key: Callable, value: Callable | None = None) -> dict[object, list]:
        out: dict = {}
        for r in self.to_list():
            out.setdefault(key(r), []).append(r if value is None else value(r))
        return out

    def to_dynamic_df(self) -> DataFrame:
        """Entities as structural columns and a bag of their properties."""
        if self.kind not in ("node", "edge"):
            raise GraphQueryError("to_dynamic needs nodes or relationships")
        df = self.to_df()
        structural = [c for c in ("_nid", "_labels", "_eid", "_type", "_src", "_dst") if c in df.columns]
        return df.select(*structural, self.graph._bag(df, tuple([*structural, "_dir"])).alias("props"))

    def __iter__(self):
        """Rows one by one, a partition at a time on the driver."""
        return iter(self.to_df().toLocalIterator())
