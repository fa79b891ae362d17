"""Grouping: by a scalar key, or by a segment's start node (correlated).

Both are one ``groupBy``; a correlated group's lists, filtered counts and sums
share its single shuffle. Only a nested grouping adds a level of its own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import GraphQueryError
from .refs import EntityRef, RowRef, SegmentRef, column


class Grouped:
    def __init__(self, query, key, correlated: bool):
        self.query, self.key_value, self.correlated = query, key, correlated

    def group_by(self, *_):
        raise GraphQueryError("a group cannot be grouped again; group inside its projection")

    def _reject(self, *_, **__):
        raise GraphQueryError("a group needs a projection first")

    where = distinct = order_by = skip = take = to_df = count = first = _reject

    def select(self, shape: Callable):
        """``shape`` gets the group and returns a dict of its key, aggregates and lists."""
        g = GroupRef(self)
        out = shape(g)
        q = self.query
        if not self.correlated and out is g.key:
            keys = q.df.select(self.key_value.alias("value")).distinct()
            return replace(q, df=keys, kind="value", aliases=(), types=(), stage="projected", orders=(), bare=False)
        if not isinstance(out, dict):
            out = {"value": out}
            single = True
        else:
            single = False
        by = F.col(column(q.aliases[0], "_nid")).alias("__key") if self.correlated else self.key_value.alias("__key")
        aggregates, names, nested = [], [], []
        for name, v in out.items():
            if v is g.key and not self.correlated:
                names.append(F.col("__key").alias(name))
                continue
            if isinstance(v, Nested):
                nested.append((name, v))
                names.append(F.col(f"`{name}`"))
                continue
            if not isinstance(v, Aggregate):
                raise GraphQueryError(f"{name}: a group's projection holds its key, aggregates and lists only")
            aggregates.append(v.column.alias(name))
            names.append(F.col(f"`{name}`"))
        df = q.df.groupBy(by)
        df = df.agg(*aggregates) if aggregates else df.agg(F.count(F.lit(1)).alias("__n"))
        for name, v in nested:
            df = df.join(v.build(q, by, name), "__key")
        return replace(q, df=df.select(*names), kind="value" if single else "row", aliases=(), types=(), stage="projected", orders=(), bare=False)


class Aggregate:
    def __init__(self, column_: Column):
        self.column = column_


class Nested:
    def __init__(self, key: Column, parts: dict[str, Column], key_names: list[str]):
        self.key, self.parts, self.key_names = key, parts, key_names

    def build(self, q, by: Column, name: str):
        inner = q.df.groupBy(by, self.key.alias("__key2")).agg(*[c.alias(k) for k, c in self.parts.items()] or [F.count(F.lit(1)).alias("__n")])
        fields = [F.col("__key2").alias(k) for k in self.key_names] + [F.col(f"`{k}`") for k in self.parts]
        return inner.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))


class KeyRef:
    """``g.key.prop`` of a correlated group: the start node's property."""

    def __init__(self, entity: EntityRef):
        self._entity = entity

    def __getattr__(self, name: str) -> Aggregate:
        return self[name]

    def __getitem__(self, name: str) -> Aggregate:
        return Aggregate(F.first(self._entity[name]))


class GroupRef:
    def __init__(self, grouped: Grouped):
        self._g = grouped
        self._item = grouped.query.ref
        self.key = KeyRef(EntityRef(grouped.query, grouped.query.aliases[0])) if grouped.correlated else grouped.key_value

    def count(self, predicate: Callable | None = None) -> Aggregate:
        if predicate is None:
            return Aggregate(F.count(F.lit(1)))
        if not self._g.correlated:
            raise GraphQueryError("a scalar group counts without a predicate")
        return Aggregate(F.count_if(F.coalesce(predicate(self._item), F.lit(False))))

    long_count = count

    def sum(self, selector: Callable) -> Aggregate:
        return Aggregate(F.coalesce(F.sum(selector(self._item)), F.lit(0)))

    def average(self, selector: Callable) -> Aggregate:
        return Aggregate(F.avg(selector(self._item)))

    def min(self, selector: Callable) -> Aggregate:
        return Aggregate(F.min(selector(self._item)))

    def max(self, selector: Callable) -> Aggregate:
        return Aggregate(F.max(selector(self._item)))

    def list(self, selector: Callable, where: Callable | None = None, order_by: Callable | None = None, descending: bool = False) -> Aggregate:
        """The group's values as a list: filtered without losing the group, ordered, or in any order."""
        if not self._g.correlated:
            raise GraphQueryError("a scalar group has no lists")
        value = selector(self._item)
        if isinstance(value, dict):
            value = F.struct(*[v.alias(k) for k, v in value.items()])
        entry = F.struct(value.alias("v")) if order_by is None else F.struct(order_by(self._item).alias("k"), value.alias("v"))
        kept = entry if where is None else F.when(F.coalesce(where(self._item), F.lit(False)), entry)
        out = F.collect_list(kept)
        if order_by is not None:
            out = F.sort_array(out, asc=not descending)
        return Aggregate(F.transform(out, lambda x: x["v"]))

    def group_by(self, key: Callable, shape: Callable) -> Nested:
        """A list of (key, aggregates) per group."""
        if not self._g.correlated:
            raise GraphQueryError("chained grouping is not supported")
        inner = GroupRef(Grouped(self._g.query, key(self._item), False))
        parts, names = {}, []
        for k, v in shape(inner).items():
            if v is inner.key:
                names.append(k)
            elif isinstance(v, Aggregate):
                parts[k] = v.column
            else:
                raise GraphQueryError("a nested group holds its key and aggregates only")
        return Nested(inner.key, parts, names)

    def _reject(self, *_, **__):
        raise GraphQueryError("a group supports its key, aggregates, lists and nested groups only")

    first = take = skip = distinct = element_at = single = _reject


def start(query, key: Callable) -> Grouped:
    if query.windows:
        raise GraphQueryError("grouping may not follow paging")
    value = key(query.ref)
    if query.kind == "segment" and isinstance(value, EntityRef) and value._alias == query.aliases[0]:
        return Grouped(query, value, True)
    if query.kind in ("segment", "path", "optional") or query.stage == "traversed":
        raise GraphQueryError("after a traversal, only its start node can be grouped by")
    if isinstance(value, (EntityRef, dict, tuple, RowRef, SegmentRef)) or not isinstance(value, Column):
        raise GraphQueryError("a group key must be a single value")
    return Grouped(query, value, False)
