"""Shortest paths by breadth-first search in workers.

Where the relationships in scope are few enough to be held by every worker, as
arrays, each worker searches from its share of the sources and emits what it
finds; nothing but the arrays is held or written. Nodes that relationships join,
in whatever direction, have places that follow one another, and so have the sources of a
worker: these are searched some at a time, each with as many cells of one array as there
are nodes that it may reach. A level's nodes stand in the order of their least
paths by relationship ids, so the first relationship that finds a node ends its
least path. What some sources find is emitted by node and then by source: columnar
files keep the few sources and the repeated node in few bytes. The paths
themselves come from a function of (source, endpoint) that searches again, and
that the plan leaves out where no path is asked for.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Relationships that a worker may hold, at 4 bytes each and 16 for each of their nodes; where paths are asked for at 15.
HELD = 4_000_000
#: Cells, and sources, that are searched together.
CELLS, TOGETHER = 8_000_000, 4096
#: Sources of a task, and found rows of a batch.
SHARE = 256
BATCH = 65_536


class Links(NamedTuple):
    """Relationships by their near end, in the order of paths; nodes are places in ``ids``.

    ``order`` has the places by id, ``bounds`` where the places of nodes begin that relationships join.
    """

    ids: np.ndarray
    order: np.ndarray
    bounds: np.ndarray
    first: np.ndarray
    far: np.ndarray


class Names(NamedTuple):
    """What only paths say of the relationships, in the same order."""

    eid: np.ndarray
    kind: np.ndarray
    kinds: list
    out: np.ndarray


def _joined(n: int, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Of each of n nodes the least one that it is joined with by relationships in whatever direction."""
    least = np.arange(n)
    while True:
        a, b = least[near], least[far]
        apart = a != b
        if not apart.any():
            return least
        near, far, a, b = near[apart], far[apart], a[apart], b[apart]
        np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(on := least[least], least):
            least = on


def links(edges: DataFrame) -> tuple[Links, Names] | None:
    """From ``__from, __to, __dir, _eid, _type``; None if they are too many."""
    edges = edges.select("__from", "__to", "_eid", F.coalesce("_type", F.lit("")).alias("kind"), (F.col("__dir") == "out").alias("out"))
    edges = edges.where(F.col("__from").isNotNull() & F.col("__to").isNotNull() & F.col("_eid").isNotNull())
    if edges.count() > HELD:
        return None
    held = edges.toArrow().combine_chunks()
    near, far, eid = (held.column(c).to_numpy().astype(np.int64) for c in ("__from", "__to", "_eid"))
    kinds, kind = np.unique(np.array(held.column("kind").to_pylist(), dtype=object).astype(str), return_inverse=True)
    out = held.column("out").to_numpy()
    ids, ends = np.unique(np.concatenate((near, far)), return_inverse=True)
    near, far = ends[: len(near)], ends[len(near) :]
    order = np.lexsort((out, far, kind, eid))
    joined = _joined(len(ids), near, far)
    by = np.argsort(joined, kind="stable")
    place = np.empty(len(ids), np.int32)
    place[by] = np.arange(len(ids), dtype=np.int32)
    bounds = np.append(np.flatnonzero(np.diff(joined[by], prepend=-1)), len(ids))
    order = order[np.argsort(place[near[order]], kind="stable")]
    first = np.searchsorted(place[near[order]], np.arange(len(ids) + 1)).astype(np.int32)
    return Links(ids[by], place, bounds, first, place[far[order]]), Names(eid[order], kind[order].astype(np.int16), kinds.tolist(), out[order])


def _cells(g: Links, sources: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each source where its cells end, and the cell that place 0 would have."""
    part = np.searchsorted(g.bounds, sources, side="right")
    ends = np.cumsum(g.bounds[part] - g.bounds[part - 1])
    return ends, ends - g.bounds[part]


def _rounds(g: Links, sources: np.ndarray):
    """The sources, some at a time."""
    ends, _ = _cells(g, sources)
    a = 0
    while a < len(sources):
        fit = np.searchsorted(ends, (ends[a - 1] if a else 0) + CELLS, side="right")
        yield sources[a : (a := min(max(a + 1, int(fit)), a + TOGETHER))]


def levels(g: Links, sources: np.ndarray, deepest: int | None, by: np.ndarray | None = None):
    """Of each level the sources' and the nodes' places; ``by`` takes of each cell the relationship that found it."""
    ends, base = _cells(g, sources)
    mark = np.full(ends[-1], -1, np.int32)
    b, v = np.arange(len(sources)), sources
    mark[base[b] + v] = 0
    depth = 0
    while len(b) and (deepest is None or depth < deepest):
        depth += 1
        begin = g.first[v].astype(np.int64)
        many = g.first[v + 1] - begin
        ends = np.cumsum(many)
        at = np.arange(ends[-1]) + np.repeat(begin - ends + many, many)
        b = np.repeat(b, many)
        cell = base[b] + g.far[at]
        new = np.flatnonzero(mark[cell] < 0)
        cell = cell[new]
        turn = np.arange(len(new), dtype=np.int32)
        mark[cell[::-1]] = turn[::-1]  # the first of equal cells is written last
        keep = mark[cell] == turn
        new = new[keep]
        if by is not None:
            by[cell[keep]] = at[new]
        b, v = b[new], g.far[at[new]].astype(np.int64)
        if len(b):
            yield depth, b, v


def _places(g: Links, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of ids, and which ids have one."""
    if not len(g.ids):
        return np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
    at = g.order[np.minimum(np.searchsorted(g.ids, ids, sorter=g.order), len(g.ids) - 1)].astype(np.int64)
    return at, g.ids[at] == ids


def found(starts: DataFrame, held: Broadcast[Links], deepest: int | None) -> DataFrame:
    """``s, cur, depth`` for each of the starts and each node that it reaches, itself apart."""

    def place(batches):
        for batch in batches:
            at, known = _places(held.value, batch.column(0).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(at[known])], names=["at"])

    def search(batches):
        g = held.value
        for batch in batches:
            for some in _rounds(g, np.sort(batch.column(0).to_numpy())):
                # a row is one number: its node, its source and its depth
                low, mid = len(g.ids).bit_length(), len(some).bit_length()
                rows = [((v << mid | b) << low) | d for d, b, v in levels(g, some, deepest)]
                if not rows:
                    continue
                rows = np.concatenate(rows)
                rows.sort()
                for i in range(0, len(rows), BATCH):
                    part = rows[i : i + BATCH]
                    of = part >> low
                    s, cur, depth = g.ids[some[of & (1 << mid) - 1]], g.ids[of >> mid], (part & (1 << low) - 1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(cur), pa.array(depth)], names=["s", "cur", "depth"])

    tasks = max(1, math.ceil(starts.count() / SHARE))
    return starts.select("s").mapInArrow(place, "at long").repartitionByRange(min(10_000, tasks), "at").mapInArrow(search, "s long, cur long, depth int")


def segments(held: Broadcast[Links], names: Broadcast[Names], way: str, back: bool, typed: bool):
    """A column of the path of each (s, cur): of (start, eid, end, direction), and the type if ``typed``; from its far end if ``back``."""
    kind = "array<struct<start:bigint,eid:bigint,end:bigint,direction:string" + (",type:string>>" if typed else ">>")

    def paths(s: pa.Array, cur: pa.Array) -> pa.Array:
        g, say = held.value, names.value
        near = np.repeat(np.arange(len(g.ids)), np.diff(g.first))
        s, _ = _places(g, s.to_numpy(zero_copy_only=False))
        cur, _ = _places(g, cur.to_numpy(zero_copy_only=False))
        steps = [None] * len(s)
        asked = np.unique(s).astype(np.int64)
        for some in _rounds(g, asked):
            ends, cells = _cells(g, some)
            by = np.full(ends[-1], -1, np.int32)
            for _ in levels(g, some, None, by):
                pass
            for row in np.flatnonzero((s >= some[0]) & (s <= some[-1])).tolist():
                at, base, trail = int(cur[row]), int(cells[np.searchsorted(some, s[row])]), []
                while at != s[row]:
                    trail.append(int(by[base + at]))
                    at = int(near[trail[-1]])
                steps[row] = trail if back else trail[::-1]
        ends = np.cumsum([0, *(len(x) for x in steps)]).astype(np.int32)
        at = np.array([x for t in steps for x in t], np.int64)
        start, end = (g.far, near) if back else (near, g.far)
        ways = np.where(say.out[at] != back, "out", "in").tolist() if way == "both" else [way] * len(at)
        parts = [pa.array(g.ids[start[at]], pa.int64()), pa.array(say.eid[at], pa.int64()), pa.array(g.ids[end[at]], pa.int64()), pa.array(ways, pa.string())]
        labels = ["start", "eid", "end", "direction"]
        if typed:
            parts.append(pa.array([say.kinds[k] for k in say.kind[at].tolist()], pa.string()))
            labels.append("type")
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(parts, names=labels))

    return F.arrow_udf(paths, kind)("s", "cur")
