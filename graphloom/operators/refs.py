"""What a lambda's parameter stands for: an entity, a segment, a path or a value in scope."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import GraphQueryError

HIDDEN = "__"


def column(alias: str, name: str) -> str:
    return f"{alias}__{name}"


class EntityRef:
    """A node or relationship: properties by attribute or ``[name]``; ``labels`` and ``type`` are structural."""

    def __init__(self, query, alias: str):
        object.__setattr__(self, "_q", query)
        object.__setattr__(self, "_alias", alias)

    def __getattr__(self, name: str) -> Column:
        return self[name]

    def __getitem__(self, name: str) -> Column:
        full = column(self._alias, name)
        if full not in self._q.df.columns:
            raise GraphQueryError(f"{self._alias}: no property {name} in scope")
        return F.col(f"`{full}`")

    @property
    def labels(self) -> Column:
        return self["_labels"]

    @property
    def type(self) -> Column:
        return self["_type"]

    @property
    def identity(self) -> Column:
        return self["_nid" if column(self._alias, "_nid") in self._q.df.columns else "_eid"]

    def is_null(self) -> Column:
        return self.identity.isNull()

    def count_relationships(self, kind: str | None, direction: str = "out") -> Column:
        """The degree; only in projections, where the counts are joined in."""
        return self._q._degree(self._alias, kind, direction)

    def columns(self) -> list[str]:
        return [c for c in self._q.df.columns if c.startswith(self._alias + "__")]


class SegmentRef:
    def __init__(self, query):
        self._q = query

    @property
    def start(self) -> EntityRef:
        return EntityRef(self._q, self._q.aliases[0])

    @property
    def relationship(self) -> EntityRef:
        return EntityRef(self._q, self._q.aliases[1])

    @property
    def end(self) -> EntityRef:
        return EntityRef(self._q, self._q.aliases[2])

    @property
    def direction(self) -> Column:
        return F.col(column(self._q.aliases[1], "_dir"))


class PathRef:
    """``start`` and ``end`` are entities; ``segments`` an array of (start, eid, end, direction)."""

    def __init__(self, query):
        self._q = query

    start = SegmentRef.start
    end = SegmentRef.end

    @property
    def segments(self) -> Column:
        return F.col(column(self._q.aliases[1], "segments"))

    def _held(self, what: str) -> Column | None:
        """A column that holds it without the segments, which a plan then leaves out."""
        name = f"{HIDDEN}{what}_{self._q.aliases[1]}"
        return F.col(name) if name in self._q.df.columns else None

    @property
    def depth(self) -> Column:
        held = self._held("depth")
        return F.size(self.segments) if held is None else held

    @property
    def edge_ids(self) -> Column:
        held = self._held("eids")
        return F.transform(self.segments, lambda s: s["eid"]) if held is None else held


class RowRef:
    """A row of a projection with several columns."""

    def __init__(self, query):
        object.__setattr__(self, "_q", query)

    def __getattr__(self, name: str) -> Column:
        return self[name]

    def __getitem__(self, name: str) -> Column:
        if name not in self._q.df.columns:
            raise GraphQueryError(f"no column {name} in scope")
        return F.col(f"`{name}`")
