"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared lower-cased with runs of anything but letters and
digits as one blank. An item of ``m`` characters may differ in
``floor(rate * m)`` edits; it is cut into one piece more than that, so any
passage within the budget holds one piece unchanged. One Aho-Corasick pass over
a text finds all pieces of all items. Pieces are the leaves of a tree of halves:
an occurrence within the budget has a leaf without an error all of whose
ancestors, of ``n`` pieces each, hold ``n - 1`` errors at most. So a hit climbs
from small ancestors to larger ones, each tested by Myers' bit-parallel distance
in its own small window, and most false hits end at the first. What arrives at
the root fixes the window in which the item's least distance is found.

Items come in blocks of bounded size; each block is one pass over the texts, so
neither memory nor what is broadcast grows with the benchmark.

Cases: null or empty texts and items match nothing; an item of so few
characters that it has no budget (below 10 at a rate of 0.1) matches whole words
only, as ``cat`` does not stand in ``concatenate``; a text is read whole; equal
items each match; repeated documents and null ids each get their rows; empty
tables give no rows; other columns are not read.
"""

from __future__ import annotations

import re
import sys
import types
import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release

RATE = 0.1
BLOCK_CHARS = 4_000_000
_OTHER = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    return _OTHER.sub(" ", text.lower()).strip() if text else ""


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget + 1`` consecutive pieces of near equal length, with their places."""
    n, out, at = budget + 1, [], 0
    for i in range(n):
        end = (i + 1) * len(item) // n
        out.append((at, item[at:end]))
        at = end
    return out


class Myers:
    """Least edit distance of a pattern to any passage of a text, by bit vectors."""

    def __init__(self, pattern: str):
        self.m = len(pattern)
        self.top, self.full = 1 << (self.m - 1), (1 << self.m) - 1
        self.equal: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.equal[c] = self.equal.get(c, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """The least distance and the first place behind a passage that has it."""
        vp, vn, score = self.full, 0, self.m
        least, end = self.m, 0
        get, top, full = self.equal.get, self.top, self.full
        for i, c in enumerate(text, 1):
            eq = get(c, 0)
            d0 = (((eq & vp) + vp) ^ vp) | eq | vn
            hp = vn | (full & ~(d0 | vp))
            hn = d0 & vp
            if hp & top:
                score += 1
            elif hn & top:
                score -= 1
                if score < least:
                    least, end = score, i
            hp = (hp << 1) & full
            hn = (hn << 1) & full
            vp = hn | (full & ~(d0 | hp))
            vn = hp & d0
        return least, end


class Item:
    """An item, its pieces, and of each piece the ancestors below the root: (start, end, errors, Myers)."""

    def __init__(self, item_id: int, text: str, budget: int):
        if not budget:
            text = f" {text} "  # whole words
        self.id, self.text, self.budget = item_id, text, budget
        self.inset = 0 if budget else 1
        self.pieces = pieces(text, budget)
        self.forward, self.backward = Myers(text), Myers(text[::-1])
        self.paths: list[list[tuple[int, int, int, Myers]]] = [[] for _ in self.pieces]
        self._halve(0, len(self.pieces), True)

    def _halve(self, a: int, b: int, root: bool) -> None:
        if b - a < 2:
            return
        self._halve(a, (a + b) // 2, False)
        self._halve((a + b) // 2, b, False)
        if not root:
            start, end = self.pieces[a][0], self.pieces[b - 1][0] + len(self.pieces[b - 1][1])
            node = (start, end, b - a - 1, Myers(self.text[start:end]))
            for j in range(a, b):
                self.paths[j].append(node)

    def plausible(self, text: str, j: int, at: int) -> bool:
        """Whether all ancestors of the piece found at ``at`` hold within their errors around it."""
        shift = at - self.pieces[j][0]
        for start, end, errors, myers in self.paths[j]:
            lo = shift + start - errors
            if myers.best(text[lo if lo > 0 else 0 : shift + end + errors])[0] > errors:
                return False
        return True


class PieceIndex:
    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items: list[Item] = []
        where: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            t = normal(text)
            if not t:
                continue
            item = Item(item_id, t, int(rate * len(t)))
            for j, (_, piece) in enumerate(item.pieces):
                where.setdefault(piece, []).append((len(self.items), j))
            self.items.append(item)
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()

    def matches(self, text: str | None, first: bool = False):
        """``(item_id, distance, start, end)`` of each item's best passage in the normalised text."""
        t = normal(text)
        if not t or not self.items:
            return []
        size, t = len(t), f" {t} "
        starts: dict[int, set[int]] = {}
        for end, (n, places) in self.automaton.iter(t):
            at = end - n + 1
            for i, j in places:
                item = self.items[i]
                start = at - item.pieces[j][0]
                if start in starts.get(i, ()):
                    continue
                if t.startswith(item.text, start) if start >= 0 else False:
                    starts.setdefault(i, set()).add(start)
                elif item.plausible(t, j, at):
                    starts.setdefault(i, set()).add(start)
        out = []
        for i, found in starts.items():
            item = self.items[i]
            best = None
            for lo, hi in _windows(sorted(found), item.budget, len(item.text)):
                lo = max(0, lo)
                window = t[lo:hi]
                exact = window.find(item.text)
                d, e = (0, exact + len(item.text)) if exact >= 0 else item.forward.best(window)
                if d <= item.budget and (best is None or d < best[0]):
                    _, back = item.backward.best(window[:e][::-1])
                    best = (d, lo + e - back, lo + e)
                    if first or d == 0:
                        break
            if best:
                d, lo, hi = best  # places without the blanks around the text
                out.append((item.id, d, max(0, lo - 1 + item.inset), min(size, hi - 1 - item.inset)))
                if first:
                    break
        return out


def _windows(starts: list[int], budget: int, length: int):
    """The places a passage may take, merged where they overlap; each start's window is whole in one."""
    lo = hi = None
    for s in starts:
        a, b = s - budget, s + length + budget
        if lo is None:
            lo, hi = a, b
        elif a <= hi:
            hi = max(hi, b)
        else:
            yield lo, hi
            lo, hi = a, b
    if lo is not None:
        yield lo, hi


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, rate: float):
    """Items in blocks, each of about ``BLOCK_CHARS`` characters, as broadcasts with names of their own."""
    total = benchmark.agg(F.sum(F.length(text_col))).first()[0] or 0
    n = -(-total // BLOCK_CHARS)
    for b in range(n):
        part = benchmark.where(F.pmod(F.xxhash64(id_col, text_col), F.lit(n)) == b) if n > 1 else benchmark
        rows = part.where(F.col(text_col).isNotNull()).select(id_col, text_col).collect()
        yield uuid.uuid4().hex, benchmark.sparkSession.sparkContext.broadcast(([(r[0], r[1]) for r in rows], rate))


def _index(name: str, held) -> PieceIndex:
    """Built once in a worker process, which Spark uses for many tasks; the last block's index is kept."""
    state = sys.modules.setdefault("_graphloom_pieces", types.ModuleType("_graphloom_pieces")).__dict__
    if state.get("name") != name:
        state.pop("index", None)
        state["index"], state["name"] = PieceIndex(*held.value), name
    return state["index"]


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, distance, start, end``: a row for each document and item within the budget.

    ``start`` and ``end`` bound the best passage in the normalised text.
    """
    schema = "doc_id long, item_id long, distance int, start int, end int"
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = docs.sparkSession.createDataFrame([], schema)
    for name, held in _blocks(benchmark, item_col, item_text_col, rate):

        def search(frames, name=name, held=held):
            index = _index(name, held)
            for pdf in frames:
                rows = [(d, *m) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) for m in index.matches(t)]
                frame = pd.DataFrame(rows, columns=["doc_id", "item_id", "distance", "start", "end"])
                yield frame.astype({"doc_id": "Int64", "item_id": "Int64"})
                release()

        out = out.union(source.mapInPandas(search, schema))
    return out


def is_leaking(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, text_col: str = "text"):
    """A list of boolean columns, one for each block of items."""
    def test(name, held):
        @F.pandas_udf("boolean")
        def leaks(texts: pd.Series) -> pd.Series:
            index = _index(name, held)
            out = pd.Series([bool(index.matches(t, first=True)) for t in texts], dtype=bool)
            release()
            return out

        return leaks(F.col(text_col))

    return [test(*block) for block in _blocks(benchmark, "item_id", "text", rate)]


def op5_decontaminate(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return find_leaks(docs, items)


def stage_decontaminate(spark, docs, sf_dir) -> DataFrame:
    """Pipeline stage: drop every document that holds a benchmark item within the edit budget.

    Null and empty texts stay; rows with null ids, repeated rows and very long
    texts are judged like any other; no column is added, so names cannot clash;
    an empty table stays empty, and with an empty benchmark all documents stay.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    for leaks in is_leaking(docs, items):
        docs = docs.where(~leaks)
    return docs
