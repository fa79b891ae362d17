"""Mutations and transactions over immutable snapshots.

A store holds the current graph. Every command freezes its selection, checks
all rules on the final rows and then swaps the snapshot, or raises and changes
nothing. A transaction works on a snapshot of its own and, on commit, repeats
its commands on the then current graph.

Changes are merged when a table is read: new and updated rows are appended, and
deleted or replaced ones are taken out by a join with the frozen selection.
Only tables of the types concerned change, and after ``COMPACT`` changes a table
is written anew, so that plans stay small. New ids come from counters.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .errors import CardinalityError, ConstraintError, GraphQueryError
from .graph import PropertyGraph
from .operators.query import GraphQuery
from .operators.refs import RowRef
from .scratch import cut

#: Changes to a table until it is written anew.
COMPACT = 8
#: New nodes' and relationships' ids begin here.
NEW_NODES, NEW_EDGES = 1000, 1 << 62

Selection = GraphQuery | Callable[[PropertyGraph], GraphQuery]


class _Rows:
    def __init__(self, df: DataFrame):
        self.df = df


def _selected(graph: PropertyGraph, selection: Selection) -> GraphQuery:
    return selection if isinstance(selection, GraphQuery) else selection(graph)


def _identities(q: GraphQuery) -> DataFrame:
    """The distinct identities of what is in scope, frozen: ``id, kind``, the most derived label or the type."""
    if q.kind not in ("node", "edge"):
        raise GraphQueryError("a command needs nodes or relationships in scope")
    df = q.to_df()
    if q.kind == "node":
        return cut(df.select(F.col("_nid").alias("id"), F.element_at("_labels", -1).alias("kind")).distinct())
    return cut(df.select(F.col("_eid").alias("id"), F.col("_type").alias("kind")).distinct())


def _kinds(ids: DataFrame) -> list[str]:
    """The types concerned; as many as the registry has."""
    return [r["kind"] for r in ids.select("kind").distinct().collect()]


def _match(ids: DataFrame, node: bool) -> DataFrame:
    """Frozen identities under the names that tables have for them."""
    return ids.select(F.col("id").alias("_nid")) if node else ids.select(F.col("id").alias("_eid"), F.col("kind").alias("_type"))


def _changed(graph: PropertyGraph, node: bool, name: str, df: DataFrame) -> PropertyGraph:
    """The graph with one more change to a table; the table is written after ``COMPACT`` of them."""
    key = ("node" if node else "edge", name)
    n = graph.pending.get(key, 0) + 1
    if n >= COMPACT:
        df, n = cut(df), 0
    out = graph.replaced(**{"nodes" if node else "edges": {name: df}})
    out.pending[key] = n
    return out


def _one(graph: PropertyGraph, selection: Selection) -> int:
    rows = _identities(_selected(graph, selection)).limit(2).collect()
    if len(rows) != 1:
        raise CardinalityError(f"an endpoint selection must match exactly one node, not {'none' if not rows else 'several'}")
    return rows[0]["id"]


def _check_properties(df: DataFrame, rules: Mapping, where: Column | None = None) -> None:
    tests = []
    for p in rules.values():
        if p.name not in df.columns:
            if p.required or p.key:
                raise ConstraintError(f"property {p.name} is required")
            continue
        c = F.col(f"`{p.name}`")
        if p.required or p.key:
            tests.append((c.isNull(), f"property {p.name} is required"))
        if p.min_length is not None:
            tests.append((F.length(c) < p.min_length, f"property {p.name} is shorter than {p.min_length}"))
        if p.max_length is not None:
            tests.append((F.length(c) > p.max_length, f"property {p.name} is longer than {p.max_length}"))
        if p.pattern is not None:
            tests.append((~c.rlike(p.pattern), f"property {p.name} does not match {p.pattern}"))
        if p.choices is not None:
            tests.append((~c.isin(*p.choices), f"property {p.name} is none of {p.choices}"))
    if not tests:
        return
    bad = F.coalesce(*[F.when(F.coalesce(t, F.lit(False)), F.lit(m)) for t, m in tests], F.lit(None))
    rows = (df if where is None else df.filter(where)).select(bad.alias("m")).filter("m is not null").limit(1).collect()
    if rows:
        raise ConstraintError(rows[0]["m"])


def _unique_groups(columns: list[str], rules: Mapping) -> list[list[str]]:
    keys = [p.name for p in rules.values() if p.key]
    groups = [keys] if keys else []
    return groups + [[p.name] for p in rules.values() if p.unique and p.name in columns]


def _check_new(held: DataFrame | None, rows: DataFrame, rules: Mapping) -> None:
    """New rows are unique among themselves and against those that are there, of which only the keys are read."""
    _check_unique(rows, rules)
    for columns in _unique_groups(rows.columns, rules) if held is not None else []:
        if all(c in held.columns for c in columns) and held.join(rows.dropna(subset=columns).select(*columns), columns, "left_semi").take(1):
            raise ConstraintError(f"{', '.join(columns)} is not unique")


def _check_unique(df: DataFrame, rules: Mapping) -> None:
    for columns in _unique_groups(df.columns, rules):
        full = df.dropna(subset=columns)
        if full.groupBy(*columns).count().filter("count > 1").take(1):
            raise ConstraintError(f"{', '.join(columns)} is not unique")


class GraphStore:
    def __init__(self, graph: PropertyGraph):
        self._graph = graph
        self._lock = threading.Lock()

    @property
    def graph(self) -> PropertyGraph:
        return self._graph

    def _run(self, command: Callable[[PropertyGraph], tuple[PropertyGraph, int]]) -> int:
        with self._lock:
            self._graph, n = command(self._graph)
            return n

    # create

    def create_node(self, label: str, properties: Mapping) -> None:
        self._run(lambda g: (_insert_node(g, label, properties)[0], 1))

    def create_nodes(self, label: str, rows: DataFrame) -> int:
        """Insert all rows at once; the set-based form of ``create_node``."""
        return self._run(lambda g: _insert_nodes(g, label, rows))

    def create(self, source: tuple[str, Mapping], relationship: tuple[str, Mapping], target: tuple[str, Mapping], direction: str = "out") -> None:
        """Two nodes and their relationship, all or none."""
        self._connect(source, relationship, target, direction)

    def create_relationship(self, source: Selection | tuple, relationship: tuple[str, Mapping], target: Selection | tuple, direction: str = "out") -> None:
        """Each end is a selection of exactly one node, or a new node as (label, properties)."""
        self._connect(source, relationship, target, direction)

    def create_self_loop(self, node: Selection, relationship: tuple[str, Mapping]) -> None:
        def command(g):
            at = _one(g, node)
            return _insert_edge(g, *relationship, at, at), 1

        self._run(command)

    def _connect(self, source, relationship, target, direction) -> None:
        if direction not in ("out", "in"):
            raise GraphQueryError(f"a stored relationship has one direction, not {direction}")

        def command(g):
            ends = []
            for end in (source, target):
                if isinstance(end, tuple):
                    g, nid = _insert_node(g, *end)
                else:
                    nid = _one(g, end)
                ends.append(nid)
            a, b = ends if direction == "out" else ends[::-1]
            return _insert_edge(g, *relationship, a, b), 1

        self._run(command)

    # update and delete

    def update(self, selection: Selection, setters: Mapping[str, object]) -> int:
        """Set properties to constants or to functions of the row before the update; how many were hit."""
        return self._run(lambda g: _update(g, selection, setters))

    def delete(self, selection: Selection, cascade: bool = False) -> int:
        """Relationships, or nodes: with incident relationships only if ``cascade``."""
        return self._run(lambda g: _delete(g, selection, cascade))

    def recreate_managed_indexes(self) -> None:
        """Tables have no indexes to keep; statistics and file layout serve scans."""

    def begin(self) -> Transaction:
        return Transaction(self)


class Transaction(GraphStore):
    """Commands on a private snapshot. Leaving the context without ``commit`` rolls back."""

    def __init__(self, store: GraphStore):
        super().__init__(store.graph)
        self._store, self._commands, self._open = store, [], True

    def update(self, selection, setters):
        return super().update(self._function(selection), setters)

    def delete(self, selection, cascade=False):
        return super().delete(self._function(selection), cascade)

    def create_self_loop(self, node, relationship):
        super().create_self_loop(self._function(node), relationship)

    def create_relationship(self, source, relationship, target, direction="out"):
        super().create_relationship(self._function(source), relationship, self._function(target), direction)

    @staticmethod
    def _function(selection):
        """A query holds the snapshot it was built on, and a commit repeats commands on a later one."""
        if isinstance(selection, GraphQuery):
            raise GraphQueryError("a selection in a transaction must be a function of the graph")
        return selection

    def _run(self, command):
        if not self._open:
            raise GraphQueryError("the transaction has ended")
        n = super()._run(command)
        self._commands.append(command)
        return n

    def begin(self):
        raise GraphQueryError("nested transactions are not supported")

    def commit(self) -> None:
        if not self._open:
            raise GraphQueryError("the transaction has ended")
        self._open = False

        def replay(g):
            for c in self._commands:
                g, _ = c(g)
            return g, 0

        self._store._run(replay)

    def rollback(self) -> None:
        self._open = False

    def __enter__(self):
        return self

    def __exit__(self, *_):
        if self._open:
            self.rollback()


def _row(graph: PropertyGraph, like: DataFrame | None, structural: dict, properties: Mapping) -> DataFrame:
    """One row with the table's types where it has the column."""
    kinds = dict(like.dtypes) if like is not None else {}
    values = {k: F.lit(v) if not isinstance(v, (list, tuple, dict)) else _literal(v) for k, v in (structural | dict(properties)).items()}
    return graph.spark.range(1).select(*[(v.cast(kinds[k]) if k in kinds else v).alias(k) for k, v in values.items()])


def _literal(v) -> Column:
    if isinstance(v, dict):
        return F.struct(*[_literal(x).alias(k) for k, x in v.items()])
    if isinstance(v, (list, tuple)):
        return F.array(*[_literal(x) for x in v])
    return F.lit(v)


def _next_node_id(graph: PropertyGraph, label: str) -> tuple[int, str]:
    """The next id of a type's family and its counter's name; the tables are looked into once only."""
    reg = graph.registry
    root = reg.lineage(label)[0]
    space = (list(reg.nodes).index(root) + NEW_NODES) << 48
    if ("node", root) not in graph.counters:
        family = [t for t in graph.node_tables if t in reg.nodes and reg.lineage(t)[0] == root]
        tops = [graph.node_tables[t].where(F.col("_nid") >= space).agg(F.max("_nid")).first()[0] for t in family]
        graph.counters["node", root] = max([t + 1 for t in tops if t is not None], default=space)
    return graph.counters["node", root], root


def _next_edge_id(graph: PropertyGraph, owner: str) -> int:
    if ("edge", owner) not in graph.counters:
        top = graph.edge_tables[owner].where(F.col("_eid") >= NEW_EDGES).agg(F.max("_eid")).first()[0] if owner in graph.edge_tables else None
        graph.counters["edge", owner] = NEW_EDGES if top is None else top + 1
    return graph.counters["edge", owner]


def _insert_node(graph: PropertyGraph, label: str, properties: Mapping) -> tuple[PropertyGraph, int]:
    reg = graph.registry
    if reg.node(label).abstract:
        raise ConstraintError(f"{label} is abstract")
    owner = reg.owner(label)
    table = graph.node_tables[owner] if owner in graph.node_tables else None
    nid, root = _next_node_id(graph, label)
    row = _row(graph, table, {"_nid": nid, "_labels": reg.lineage(label)}, properties)
    out = _store_nodes(graph, label, owner, table, row)
    out.counters["node", root] = nid + 1
    return out, nid


def _store_nodes(graph: PropertyGraph, label: str, owner: str, table: DataFrame | None, rows: DataFrame) -> PropertyGraph:
    reg = graph.registry
    rules = reg.node_rules(label)
    _check_properties(rows, rules)
    if any(p.key or p.unique for p in rules.values()):
        lineage = reg.lineage(label)
        declaring = next((t for t in lineage if any(p.key or p.unique for p in reg.node(t).properties)), lineage[0])
        there = any(reg.owner(x) in graph.node_tables for x in reg.compatible_labels(declaring))
        _check_new(graph.node_df(declaring) if there else None, rows, rules)
    return _changed(graph, True, owner, rows if table is None else table.unionByName(rows, allowMissingColumns=True))


def _insert_nodes(graph: PropertyGraph, label: str, rows: DataFrame) -> tuple[PropertyGraph, int]:
    reg = graph.registry
    owner = reg.owner(label)
    table = graph.node_tables[owner] if owner in graph.node_tables else None
    start, root = _next_node_id(graph, label)
    labels = F.array(*[F.lit(x) for x in reg.lineage(label)])
    new = cut(rows.select((F.lit(start) + F.monotonically_increasing_id()).alias("_nid"), labels.alias("_labels"), *rows.columns))
    out = _store_nodes(graph, label, owner, table, new)
    sums = new.agg(F.count(F.lit(1)).alias("n"), F.max("_nid").alias("top")).first()
    out.counters["node", root] = start if sums["top"] is None else sums["top"] + 1
    return out, sums["n"]


def _insert_edge(graph: PropertyGraph, kind: str, properties: Mapping, source: int, target: int) -> PropertyGraph:
    reg = graph.registry
    if reg.edge(kind).abstract:
        raise ConstraintError(f"{kind} is abstract")
    owner = reg.edge_owner(kind)
    table = graph.edge_tables[owner] if owner in graph.edge_tables else None
    eid = _next_edge_id(graph, owner)
    row = _row(graph, table, {"_eid": eid, "_type": kind, "_src": source, "_dst": target}, properties)
    rules = reg.edge_rules(kind)
    _check_properties(row, rules)
    if any(p.key or p.unique for p in rules.values()):
        _check_new(table, row, rules)
    out = _changed(graph, False, owner, row if table is None else table.unionByName(row, allowMissingColumns=True))
    out.counters["edge", owner] = eid + 1
    return out


def _update(graph: PropertyGraph, selection: Selection, setters: Mapping) -> tuple[PropertyGraph, int]:
    q = _selected(graph, selection)
    for c in setters:
        if c in ("_nid", "_labels", "_eid", "_type", "_src", "_dst"):
            raise GraphQueryError(f"{c} cannot be set")
    ids = _identities(q)
    node, reg = q.kind == "node", graph.registry
    tables, owner = (graph.node_tables, graph.owner_of_label) if node else (graph.edge_tables, graph.owner_of_type)
    match = _match(ids, node)
    after, names = graph, [t for t in dict.fromkeys(owner(k) for k in _kinds(ids)) if t in tables]
    for name in names:
        table = tables[name]
        hit, kinds = table.join(match, match.columns, "left_semi").select(*table.columns), dict(table.dtypes)
        columns = []
        for c in [*table.columns, *[x for x in setters if x not in table.columns]]:
            value = F.col(f"`{c}`")
            if c in setters:
                value = setters[c](RowRef(_Rows(hit))) if callable(setters[c]) else _literal(setters[c])
                value = value.cast(kinds[c]) if c in kinds else value
            columns.append(value.alias(c))
        rows = cut(hit.select(*columns))
        rules = reg.node_rules(name) if node and name in reg.nodes else reg.edge_rules(name) if not node and name in reg.edges else {}
        _check_properties(rows, rules)
        rest = table.join(match, match.columns, "left_anti").select(*table.columns)
        after = _changed(after, node, name, rest.unionByName(rows, allowMissingColumns=True))
    for name in names:
        rules = (reg.node_rules if node else reg.edge_rules)(name)
        if any((p.key or p.unique) and p.name in setters for p in rules.values()):
            _check_unique(after.node_df(name) if node else after.edge_df(name), rules)
    return after, ids.count()


def _delete(graph: PropertyGraph, selection: Selection, cascade: bool) -> tuple[PropertyGraph, int]:
    q = _selected(graph, selection)
    ids, reg = _identities(q), graph.registry
    kinds = _kinds(ids)
    match = _match(ids, q.kind == "node")
    out = graph
    if q.kind == "edge":
        for name in [t for t in dict.fromkeys(graph.owner_of_type(k) for k in kinds) if t in graph.edge_tables]:
            table = graph.edge_tables[name]
            out = _changed(out, False, name, table.join(match, match.columns, "left_anti").select(*table.columns))
        return out, ids.count()

    def may_be(end: str | None) -> bool:
        """Whether a node of the types concerned can be an end of the declared type."""
        if end is None or end not in reg.nodes:
            return True
        return any(k not in reg.nodes or k in reg.compatible_labels(end) or end in reg.compatible_labels(k) for k in kinds)

    for name in list(graph.edge_tables):
        declared = reg.edges.get(name)
        ends = [c for c, end in (("_src", declared and declared.source), ("_dst", declared and declared.target)) if may_be(end)]
        if not ends or not kinds:
            continue
        table = graph.edge_tables[name]
        incident = table.select(F.explode(F.array(*ends)).alias("_nid")).join(match, "_nid", "left_semi")
        if not incident.take(1):
            continue
        if not cascade:
            raise ConstraintError("nodes with relationships are only deleted by cascade")
        kept = table
        for c in ends:
            kept = kept.join(match.select(F.col("_nid").alias(c)), c, "left_anti")
        out = _changed(out, False, name, kept.select(*table.columns))
    for name in [t for t in dict.fromkeys(graph.owner_of_label(k) for k in kinds) if t in graph.node_tables]:
        table = graph.node_tables[name]
        out = _changed(out, True, name, table.join(match, "_nid", "left_anti").select(*table.columns))
    return out, ids.count()
