"""Traversals as joins.

A hop joins the nodes in scope with oriented relationships and these with the
target nodes. Depth ranges unroll into one join a hop over ids alone; every
trail uses a relationship once, where one is told by its id and, if relationships
of several tables are in scope, its type; relationship filters apply before the
first hop, and an id that no node table holds is no step of a trail. Where the types in scope
end them after few levels, shortest paths are one plan, and only small levels are
written. Otherwise the search for one path runs in
workers, if they can hold the relationships (see ``walks``), or paths advance level by level with an anti-join on what was seen, from the
sources or, where there are fewer of them, backwards from the endpoints; these levels, and trails deeper than ``UNROLL``, run jobs while the
query is built.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import GraphQueryError
from ..scratch import cut
from . import walks
from .refs import HIDDEN, EntityRef, column

MAX_DEPTH = 64
#: Levels up to here are one plan; deeper ones are written out to keep plans small.
UNROLL = 4
#: Trails of a level, and bytes of tables, that are sent to all executors.
FEW, SMALL = 200_000, 32_000_000


def oriented(graph, kind: str | None, direction: str, where: Callable | None, keep: bool = False) -> DataFrame:
    """Relationships as ``__from, __to, __dir`` and, with ``keep``, all their columns.

    With ``both`` a loop is there once.
    """
    if direction not in ("out", "in", "both"):
        raise GraphQueryError(f"unknown direction {direction}")
    df = graph.edge_df(kind)
    if where is not None:
        scope = type("Scope", (), {})()
        scope.df = df.select(*[F.col(f"`{c}`").alias(column("r", c)) for c in df.columns])
        renamed = scope.df.filter(where(EntityRef(scope, "r")))
        df = renamed.select(*[F.col(f"`{c}`").alias(c[3:]) for c in renamed.columns])
    kept = [F.col(f"`{c}`") for c in df.columns] if keep else [F.col(c) for c in ("_eid", "_type") if c in df.columns]

    def way(a: str, b: str, name: str, source: DataFrame) -> DataFrame:
        return source.select(F.col(a).alias("__from"), F.col(b).alias("__to"), F.lit(name).alias("__dir"), *kept)

    if direction == "out":
        return way("_src", "_dst", "out", df)
    if direction == "in":
        return way("_dst", "_src", "in", df)
    return way("_src", "_dst", "out", df).unionByName(way("_dst", "_src", "in", df.filter(F.col("_src") != F.col("_dst"))))


def _source(query, what: str):
    query._check_open(what)
    if query.kind == "mixed":
        raise GraphQueryError("a mixed search cannot be traversed")
    if query.kind != "node":
        raise GraphQueryError(f"{what} needs nodes in scope")
    q = query._close_window(what)
    step = int(q.aliases[-1][1:]) + 1 if q.aliases[-1][1:].isdigit() else 100
    return q, q.aliases[-1], f"r{step}", f"n{step}"


def _targets(graph, target: str | None, alias: str) -> DataFrame:
    df = graph.node_df(target) if target is not None else graph.dynamic_node_df()
    return df.select(*[F.col(f"`{c}`").alias(column(alias, c)) for c in df.columns])


def segments(query, kind, target, direction, where, optional: bool = False):
    q, src, rel, tgt = _source(query, "a traversal")
    edges = oriented(q.graph, kind, direction, where, keep=True)
    edges = edges.select("__from", "__to", F.col("__dir").alias(column(rel, "_dir")), *[F.col(f"`{c}`").alias(column(rel, c)) for c in edges.columns if not c.startswith("__")])
    nodes = _targets(q.graph, target, tgt)
    from_src = F.col(column(src, "_nid")) == F.col("__from")
    if optional:
        reached = edges.join(nodes, F.col("__to") == F.col(column(tgt, "_nid")))
        df = q.df.join(reached, from_src, "left")
    else:
        df = q.df.join(edges, from_src).join(nodes, F.col("__to") == F.col(column(tgt, "_nid")))
    return replace(q, df=df.drop("__from", "__to"), kind="optional" if optional else "segment", aliases=(src, rel, tgt), types=(q.types[-1], kind, target), stage="traversed", bare=False)


def _check_depth(low: int, high: int) -> None:
    if low < 1 or high < low:
        raise GraphQueryError("a depth range needs 1 <= min <= max")
    if high > MAX_DEPTH:
        raise GraphQueryError(f"a depth over {MAX_DEPTH} is not supported")


class _Trails:
    """How trails are held while they grow: ids alone, in arrays.

    ``s, cur, nodes, eids`` and, for both directions, ``outs``. Where several
    tables are in scope, ``eids`` holds (eid, type).
    """

    def __init__(self, graph, kind, direction: str):
        self.several = len(graph.edge_table_names(kind)) > 1
        self.direction = direction
        self.columns = ["nodes", "eids", *(["outs"] if direction == "both" else [])]

    def start(self, ids: DataFrame) -> DataFrame:
        kinds = {"nodes": "array<bigint>", "eids": "array<struct<eid:bigint,type:string>>" if self.several else "array<bigint>", "outs": "array<boolean>"}
        return ids.select("s", F.col("s").alias("cur"), *[F.array().cast(kinds[c]).alias(c) for c in self.columns])

    def advance(self, frontier: DataFrame, edges: DataFrame) -> DataFrame:
        """One hop further; no relationship twice in a trail."""
        used = F.struct(F.col("_eid").alias("eid"), F.col("_type").alias("type")) if self.several else F.col("_eid")
        step = frontier.join(edges, F.col("cur") == F.col("__from")).filter(~F.array_contains("eids", used))
        new = {"nodes": F.col("__to"), "eids": used, "outs": F.col("__dir") == "out"}
        return step.select("s", F.col("__to").alias("cur"), *[F.concat(c, F.array(new[c])).alias(c) for c in self.columns])

    def turned(self, trails: DataFrame) -> DataFrame:
        """Trails that were found backwards, as from their other end."""
        before = F.slice(F.concat(F.array("s"), "nodes"), F.lit(1), F.size("nodes"))
        new = {"nodes": F.reverse(before), "eids": F.reverse("eids"), "outs": F.transform(F.reverse("outs"), lambda x: ~x) if "outs" in self.columns else None}
        return trails.select(F.col("cur").alias("s"), F.col("s").alias("cur"), *[new[c].alias(c) for c in self.columns])

    def segments(self):
        """An array of (start, eid, end, direction), and the type where several tables are in scope."""
        def of(i):
            eid = F.get("eids", i)
            way = F.when(F.get("outs", i), "out").otherwise("in") if "outs" in self.columns else F.lit(self.direction)
            parts = [
                F.when(i == 0, F.col("s")).otherwise(F.get("nodes", i - 1)).alias("start"), (eid["eid"] if self.several else eid).alias("eid"),
                F.get("nodes", i).alias("end"), way.alias("direction"), *([eid["type"].alias("type")] if self.several else []),
            ]
            return F.struct(*parts)

        return F.transform(F.sequence(F.lit(0), F.size("eids") - 1), of)

    def paths(self, rel: str) -> list:
        """What a path in scope consists of; a plan computes what is asked for."""
        eids = F.transform("eids", lambda x: x["eid"]) if self.several else F.col("eids")
        return [self.segments().alias(column(rel, "segments")), F.size("eids").alias(f"{HIDDEN}depth_{rel}"), eids.alias(f"{HIDDEN}eids_{rel}")]


def _sources(q, src: str) -> DataFrame:
    return q.df.select(F.col(column(src, "_nid")).alias("s")).distinct()


def _steps(graph, kind, direction, where, names: set | None = None) -> DataFrame:
    """Oriented relationships whose far end is a node; of any type, those of the tables named."""
    declared = graph.registry.edges.get(kind) if kind is not None else None
    ends = [] if declared is None else {"out": [declared.target], "in": [declared.source], "both": [declared.source, declared.target]}[direction]
    if ends and all(x is not None for x in ends):
        there = reduce(DataFrame.unionByName, [graph.node_df(x).select("_nid") for x in dict.fromkeys(ends)])
    else:
        there = reduce(DataFrame.unionByName, [t.select("_nid") for t in graph.node_tables.values()])
    edges = oriented(graph, kind, direction, where) if names is None else _among(graph, kind, direction, names)
    return edges.join(there.select(F.col("_nid").alias("__to")), "__to", "left_semi")


def _targets_where(graph, target, alias: str, keep) -> DataFrame:
    nodes = _targets(graph, target, alias)
    return nodes if keep is None else nodes.filter(keep(EntityRef(type("Scope", (), {"df": nodes})(), alias)))


def is_small(df: DataFrame) -> bool:
    """Whether its tables are small enough to be sent to all executors."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= SMALL


def joins_small(df: DataFrame) -> bool:
    """Whether both sides of the join that ``df`` projects are small, by the columns that it asks for."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.children().size() == 1:
        plan = plan.children().apply(0)
    sides = [plan.children().apply(i) for i in range(plan.children().size())]
    return len(sides) == 2 and all(int(x.stats().sizeInBytes()) <= SMALL for x in sides)


def _small(df: DataFrame, rows: int = 0) -> DataFrame:
    """Sent to all executors if its tables are small or, however wide they are, it has no more than ``rows``; plans send what is asked for."""
    return F.broadcast(df) if is_small(df) or rows and df.count() <= rows else df


def _attach(q, src: str, rel: str, tgt: str, kind, target, found: DataFrame, paths: list, keep=None, small: bool = False, rows: int = 0):
    """Join source rows, found trails ``s, cur`` with columns of their paths, and target nodes; their properties meet here only.

    Where ``small`` both are sent to the trails if their tables are small, or have no more than ``rows``: else all trails are shuffled.
    """
    nodes = _targets_where(q.graph, target, tgt, keep)
    sources = q.df
    if small:
        nodes, sources = _small(nodes, rows), _small(sources, rows)
    found = found.select(F.col("s").alias("__s"), F.col("cur").alias("__e"), *paths)
    df = found.join(sources, F.col(column(src, "_nid")) == F.col("__s")).join(nodes, F.col("__e") == F.col(column(tgt, "_nid")))
    hidden = [f"{HIDDEN}depth_{rel}", f"{HIDDEN}eids_{rel}"]
    held = [x for x in (*q.df.columns, column(rel, "segments"), *nodes.columns, *hidden) if x in df.columns]
    df = df.select(*[F.col(f"`{x}`") for x in held])
    return replace(q, df=df, kind="path", aliases=(src, rel, tgt), types=(q.types[-1], kind, target), stage="traversed", bare=False)


def trails(query, kind, target, low: int, high: int, direction, where, paths: bool = True):
    _check_depth(low, high)
    q, src, rel, tgt = _source(query, "a traversal")
    edges = _steps(q.graph, kind, direction, where)
    how = _Trails(q.graph, kind, direction)
    frontier, levels = how.start(_sources(q, src)), []
    for depth in range(1, high + 1):
        frontier = how.advance(frontier, edges)
        if depth % UNROLL == 0 and depth < high:
            frontier = cut(frontier)
        if depth >= low:
            levels.append(frontier)
    return _attach(q, src, rel, tgt, kind, target, reduce(DataFrame.unionByName, levels), how.paths(rel) if paths else [])


def _hops(graph, kind, way: str) -> list[tuple[str, set, set]]:
    """Of each relationship table in scope and way through it: the table, and the node tables that it leads from and to.

    Relationships of a type without declared ends, or that a store has added, may lead anywhere.
    """
    reg = graph.registry

    def tables(end: str | None) -> set:
        return set(graph.node_tables) if end is None or end not in reg.nodes else {reg.owner(x) for x in reg.compatible_labels(end)} & set(graph.node_tables)

    out = []
    for name in graph.edge_table_names(kind):
        below = [reg.edges[t] for t in reg.compatible_types(name)] if name in reg.edges and ("edge", name) not in graph.counters else [None]
        a, b = (set().union(*(tables(t and getattr(t, end)) for t in below)) for end in ("source", "target"))
        out += [(name, x, y) for w, x, y in (("out", a, b), ("in", b, a)) if way in (w, "both")]
    return out


def _useful(hops: list, last: set) -> set:
    """The node tables from which hops lead to one of the last."""
    out = set(last)
    while more := {x for _, a, b in hops if b & out for x in a} - out:
        out |= more
    return out


def _layers(hops: list, first: set, last: set) -> list[tuple[set, set]] | None:
    """Of each level the relationship tables that lead on towards the last node tables, and the node tables they lead to.

    None if that does not end after ``UNROLL`` levels.
    """
    useful = _useful(hops, last)
    layers, at = [], first & useful
    while True:
        used = [(name, b & useful) for name, a, b in hops if a & at and b & useful]
        if not used:
            return layers
        if len(layers) == UNROLL:
            return None
        at = set().union(*(b for _, b in used))
        layers.append(({name for name, _ in used}, at))


def _owners(graph, label: str | None) -> set:
    reg = graph.registry
    if label is None or label not in reg.nodes:
        return set(graph.node_tables)
    return {reg.owner(x) for x in reg.compatible_labels(label)} & set(graph.node_tables)


def _among(graph, kind, direction: str, names: set) -> DataFrame:
    """Relationships of some of the tables in scope, oriented."""
    if kind is not None:
        return oriented(graph, kind, direction, None)
    part = graph.replaced()
    part.edge_tables = {n: graph.edge_tables[n] for n in graph.edge_tables if n in names}
    return oriented(part, None, direction, None)


def _least(step: DataFrame, how: _Trails) -> DataFrame:
    """Of the trails to a node the least by relationship ids."""
    least = step.groupBy("s", "cur").agg(F.min(F.struct("eids", *[c for c in how.columns if c != "eids"])).alias("p"))
    return least.select("s", "cur", *[f"p.{c}" for c in how.columns])


def _layered(graph, kind, how: _Trails, way: str, first: DataFrame, owners: set, last: set, layers: list, every: bool, max_depth: int | None) -> DataFrame:
    """Shortest trails where the types in scope end them after few levels: one plan, in which only small levels are written."""
    frontier, levels, before = how.start(first), [], [(owners, None)]
    for depth, (names, to) in enumerate(layers[:max_depth], 1):
        if depth > 1:
            there = reduce(DataFrame.unionByName, [graph.node_tables[n].select(F.col("_nid").alias("cur")) for n in sorted(before[-1][0])])
            frontier = frontier.join(there, "cur", "left_semi")
            if frontier.count() <= FEW:
                frontier = F.broadcast(cut(frontier))
        step = how.advance(frontier, _among(graph, kind, way, names))
        for held, level in before:  # a node of a type that an earlier level has may have been seen
            if held & to:
                step = step.where(F.col("s") != F.col("cur")) if level is None else step.join(level.select("s", "cur").distinct(), ["s", "cur"], "left_anti")
        frontier = step if every else _least(step, how)
        before.append((to, frontier))
        if to & last:
            levels.append(frontier)
    return reduce(DataFrame.unionByName, levels) if levels else how.start(first).limit(0)


def shortest(query, kind, target, predicate, direction, every: bool, max_depth: int | None = None):
    q, src, rel, tgt = _source(query, "a shortest path")
    graph, starts = q.graph, _sources(q, src)
    ends = _targets_where(graph, target, tgt, predicate).select(F.col(column(tgt, "_nid")).alias("s"))
    if predicate is not None:
        ends = cut(ends.distinct())
    back = ends.count() < (starts if predicate is not None else q.df).count()
    way = {"out": "in", "in": "out"}.get(direction, direction) if back else direction
    how = _Trails(graph, kind, way)
    first, last = _owners(graph, q.types[-1]), _owners(graph, target)
    first, last = (last, first) if back else (first, last)
    hops = _hops(graph, kind, way)
    layers = _layers(hops, first, last)
    begin = ends.distinct() if back else starts
    if layers is not None:
        found = _layered(graph, kind, how, way, begin, first, last, layers, every, max_depth)
    else:
        useful = _useful(hops, last)
        names = {name for name, a, b in hops if a & useful and b & useful}
        edges = cut(_steps(graph, kind, way, None, names))
        held = None if every else walks.links(edges)
        if held is not None:
            held, names = (edges.sparkSession.sparkContext.broadcast(x) for x in held)
            found = walks.found(begin, held, max_depth)
            segments = walks.segments(held, names, direction, back, how.several)
            paths = [segments.alias(column(rel, "segments")), F.col("depth").alias(f"{HIDDEN}depth_{rel}")]
            ends = [F.col("cur").alias("s"), F.col("s").alias("cur")] if back else ["s", "cur"]
            found = found.select(*ends, *paths)
            return _attach(q, src, rel, tgt, kind, target, found, [x for x in found.columns if x not in ("s", "cur")], keep=predicate, small=True, rows=walks.HELD)
        found = _by_levels(how, begin, edges, every, max_depth)
    if back:
        how.direction = direction
        found = how.turned(found)
    return _attach(q, src, rel, tgt, kind, target, found, how.paths(rel), keep=predicate, small=True)


def _by_levels(how: _Trails, begin: DataFrame, edges: DataFrame, every: bool, max_depth: int | None) -> DataFrame:
    """Shortest trails of any depth; each level is written."""
    frontier = how.start(begin)
    seen = cut(frontier.select("s", "cur"))
    levels: list[DataFrame] = []
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = how.advance(frontier, edges).join(seen, ["s", "cur"], "left_anti")
        frontier = cut(step if every else _least(step, how))
        if not frontier.take(1):
            break
        levels.append(frontier)
        seen = seen.unionByName(frontier.select("s", "cur").distinct())
        if depth % UNROLL == 0:
            seen = cut(seen)
    return reduce(DataFrame.unionByName, levels or [frontier])


def with_degree(graph, df: DataFrame, alias: str, kind, direction: str, name: str) -> DataFrame:
    """Add the number of incident relationships, counted before the join."""
    counts = oriented(graph, kind, direction, None).groupBy("__from").agg(F.count(F.lit(1)).alias("__n"))
    out = df.join(counts, F.col(column(alias, "_nid")) == F.col("__from"), "left")
    return out.withColumn(name, F.coalesce("__n", F.lit(0)).cast("long")).drop("__from", "__n")
