"""MinHash near-dedup by DartMinHash signatures.

Elements are shingles of five words (white-space separated, lower case; a
shorter text is one shingle). A shingle that occurs ``c`` times weighs ``c``:
a text is the set of its (shingle, occurrence) pairs, and similarity is the
Jaccard similarity of these sets, that is the weighted one of the shingles
(``weighted=False``: every shingle weighs 1). Darts are thrown over element x
weight x rank by a hash that all documents share, one on average to each unit
cell. A document keeps the darts that fall within its elements' weights up to
the rank by which all coordinates are expected to be filled, and of each
coordinate the earliest. Two documents agree in a coordinate with a probability
equal to their similarity. A coordinate left empty (one in a thousand) is used
in no band.

1. Equal texts form a class, represented by its least id.
2. ``BANDS`` bands of ``ROWS`` coordinates, dealt from ``COORDINATES`` by fixed
   permutations, become bucket keys; of pairs of similarity 0.8 about one in
   fifteen thousand shares none (see the test).
3. Of the documents that share a bucket, those go of whose shingles less than
   the similarity's share occurs in any other: they can have no partner.
4. Each bucket's best connected member (the one that meets most others in all
   its buckets) leads it and is compared with the members, by the exact
   similarity. Links join components; a bucket is done when its members are all
   of one. Buckets that are left and whose comparisons would cost more rows
   than dealing them does are dealt anew by what members do not share with a
   common leader (see ``_deal``), which is exact: strangers in a large group
   then only meet the members that they can equal.
5. In rounds, up to ``LEADERS`` members of each bucket's smallest components
   are compared with its members of other components and leave the bucket. A
   bucket of n members costs n rows a round, with a list of its leaders; a pair
   that meets in several buckets is compared once.
6. Linked classes are joined to components, each named by its least id.

Cases: null and empty texts hold no shingle and are linked with one another
only, as equal texts; rows with the same id are one document and get one class;
a row without id is named by a negative hash of its text; repeated rows are
kept in the result, and one row of them in the stage; empty tables give no
rows; long texts are read whole; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, discard, doc_key, release, save, slices, text_key

WORDS = 5
SIMILARITY = 0.8
COORDINATES = 120
BANDS = 40
ROWS = 6
LEADERS = 64
CHUNK = 500_000  # characters, and cells of darts, which bound a worker's arrays
CELLS = 500_000

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_BASE_INV = _U(pow(int(_BASE), -1, 1 << 64))
_SPACES = np.zeros(256, bool)
_SPACES[list(b" \t\n\r\f\v\x00")] = True
_SEEDS = [_U(s) for s in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _salt(seed: int, n: int) -> np.uint64:
    return _U(int(_SEEDS[seed]) * n & (1 << 64) - 1)


def _powers(base, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


def shingles(texts: list[str | None], size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles of all texts, and which text each is from."""
    data = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    buf = np.frombuffer(b" ".join(data) + b" ", np.uint8)
    ends = np.cumsum([len(d) + 1 for d in data])
    space = _SPACES[buf]
    inner = ~space
    starts = np.flatnonzero(inner & np.concatenate(([True], space[:-1])))
    stops = np.flatnonzero(space & np.concatenate(([False], inner[:-1])))
    if not len(starts):
        return np.zeros(0, _U), np.zeros(0, np.int64)
    sums = np.concatenate((np.zeros(1, _U), np.cumsum((buf.astype(_U) + _U(1)) * _powers(_BASE, len(buf)))))
    words = _mix((sums[stops] - sums[starts]) * _powers(_BASE_INV, len(buf) + 1)[starts] + (stops - starts).astype(_U))
    owner = np.searchsorted(ends, starts, side="right")
    counts = np.bincount(owner, minlength=len(texts))
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    whole = np.minimum(counts, size)  # words in a shingle of each text
    left = (first + counts)[owner] - np.arange(len(words))
    at = np.flatnonzero(left >= whole[owner])
    out = np.zeros(len(at), _U)
    for k in range(size):
        use = k < whole[owner[at]]
        out[use] += _mix(words[at[use] + k] ^ _SEEDS[k % len(_SEEDS)] ^ _U(k))
    return _mix(out), owner[at]


def _distinct(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, hash) in order, with how often each occurs."""
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    return h[at], o[at], np.diff(np.append(at, len(h)))


_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(13)])
_CELL = np.array([int(p * 2.0**64) if p < 1 - 1e-12 else 2**64 - 1 for p in _POISSON], dtype=_U)


def dart_signatures(hashes: np.ndarray, owner: np.ndarray, weights: np.ndarray, n: int, k: int) -> np.ndarray:
    """n signatures of k ranks; a rank names its dart, the largest value an empty coordinate. Owners ascend."""
    best = np.full(n * k, np.iinfo(np.uint64).max, _U)
    mass = np.bincount(owner, weights=weights, minlength=n)
    needed = k * math.log(k) + 2 * k
    low = 64 - math.ceil(math.log2(needed + 2))  # a rank's bits below its whole part, the same for all documents
    limit = needed / np.maximum(mass, 1)  # ranks up to here
    # unit cells of weight, and of each its ranks; some documents at a time
    e = np.repeat(np.arange(len(hashes)), weights)
    unit = np.arange(len(e)) - np.repeat(np.cumsum(weights) - weights, weights)
    cell0 = _mix(hashes[e] + unit.astype(_U) * _SEEDS[0])
    o = owner[e]
    ranks = np.ceil(limit[o]).astype(np.int64)
    upto = np.cumsum(ranks)
    a = 0
    while a < len(o):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + CELLS, side="right")))
        at = np.repeat(np.arange(a, b), ranks[a:b])
        r = (np.arange(len(at)) - np.repeat(upto[a:b] - ranks[a:b] - (upto[a - 1] if a else 0), ranks[a:b])).astype(_U)
        cell = _mix(cell0[at] ^ r * _SEEDS[1])
        own = o[at]
        darts = np.searchsorted(_CELL, cell, side="right")
        hit = np.flatnonzero(darts > 0)
        d = 0
        while len(hit):
            d += 1
            dart = _mix(cell[hit] + _salt(2, d))
            rank = (r[hit] << _U(low)) | (dart >> _U(64 - low))
            within = rank < (limit[own[hit]] * 2.0**low).astype(_U)
            coordinate = (_mix(dart ^ _SEEDS[3]) >> _U(32)).astype(np.int64) * k >> 32
            np.minimum.at(best, (own[hit] * k + coordinate)[within], rank[within])
            hit = hit[darts[hit] > d]
        a = b
    return best.reshape(n, k)


def _subsets(coordinates: int, bands: int, rows: int) -> np.ndarray:
    """The coordinates of each band, taken from one fixed permutation after the other."""
    each = coordinates // rows
    order = [np.argsort(_mix(np.arange(coordinates, dtype=_U) + _salt(4, p + 1)), kind="stable") for p in range(-(-bands // each))]
    return np.vstack([p[: each * rows].reshape(each, rows) for p in order])[:bands]


def _bands(best: np.ndarray, subsets: np.ndarray) -> list[np.ndarray]:
    """Of each document the keys of the bands without an empty coordinate."""
    n, (bands, rows) = len(best), subsets.shape
    key = np.zeros((n, bands), _U) + np.arange(1, bands + 1, dtype=_U) * _SEEDS[4]
    full = np.ones((n, bands), bool)
    for i in range(rows):
        cut = best[:, subsets[:, i]]
        key = _mix(key ^ cut)
        full &= cut != np.iinfo(np.uint64).max
    key = key.view(np.int64)
    return [key[i][full[i]] for i in range(n)]


def signatures(docs: DataFrame, coordinates: int, bands: int, rows: int, weighted: bool) -> DataFrame:
    """From ``dk, tk, text``: ``dk, tk, bands``."""
    subsets = _subsets(coordinates, bands, rows)

    def sign(batches):
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            for a, b in chunks(texts, CHUNK):
                h, o, c = _distinct(*shingles(texts[a:b]))
                best = dart_signatures(h, o, c if weighted else np.ones_like(c), b - a, coordinates)
                yield _arrays(batch, a, b, ("dk", "tk"), "bands", _bands(best, subsets))

    return docs.select("dk", "tk", "text").mapInArrow(sign, "dk long, tk string, bands array<bigint>")


def _arrays(batch: pa.RecordBatch, a: int, b: int, keep: tuple[str, ...], name: str, arrays: list[np.ndarray]) -> pa.RecordBatch:
    """Rows a to b of some columns, and a column of arrays."""
    ends = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    held = pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int64()))
    return pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in keep), held], names=[*keep, name])


def shingle_sets(docs: DataFrame, weighted: bool = True) -> DataFrame:
    """From ``dk, tk, text``: ``rep, tk, grams``, the distinct (shingle, occurrence) pairs as hashes."""
    def collect(batches):
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            for a, b in chunks(texts, CHUNK):
                h, o, c = _distinct(*shingles(texts[a:b]))
                if weighted:
                    turn = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                    h, o = _mix(np.repeat(h, c) + turn.astype(_U) * _SEEDS[0]), np.repeat(o, c)
                cuts = np.searchsorted(o, np.arange(b - a + 1))
                yield _arrays(batch, a, b, ("rep", "tk"), "grams", [h[cuts[i] : cuts[i + 1]].view(np.int64) for i in range(b - a)])

    return docs.select(F.col("dk").alias("rep"), "tk", "text").mapInArrow(collect, "rep long, tk string, grams array<bigint>").dropDuplicates(["rep", "tk"])


def frequencies(sets: DataFrame) -> DataFrame:
    """Add ``common`` to saved sets ``sid, rep, grams``: of the shingles that another document has too, how many have them, as (gram, c)."""
    each = sets.select("sid", F.explode("grams").alias("gram"))
    times = each.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1)
    common = each.join(times, "gram").groupBy("sid").agg(F.collect_list(F.struct("gram", "c")).alias("common"))
    return sets.join(common, "sid", "left").withColumn("common", F.coalesce("common", F.array().cast("array<struct<gram:bigint,c:bigint>>")))


def jaccard(a: str, b: str) -> Column:
    """Of two columns that hold arrays of distinct elements."""
    both = F.size(F.array_intersect(a, b))
    return both / F.greatest(F.lit(1), F.size(a) + F.size(b) - both)


def components(links: DataFrame) -> DataFrame:
    """``node, comp``: each linked node with its component's least node, from ``a, b`` pairs.

    Every node takes the least name among its own and its neighbours', then the
    name of the one it is named after, until nothing changes.
    """
    edges = save(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct(), "edges")
    names = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("comp")).withColumnRenamed("u", "node")
    names = save(names, "names")
    while True:
        near = edges.join(names.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("comp").alias("near"))
        step = names.join(near.withColumnRenamed("u", "node"), "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = names.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        step = save(step.join(jump, "comp", "left").select("node", "old", F.least("comp", F.coalesce("further", "comp")).alias("comp")), "names")
        names = step.select("node", "comp")
        if not step.where(F.col("old") != F.col("comp")).take(1):
            return names


def _several(held: DataFrame, by: str = "rep") -> DataFrame:
    """The buckets that hold more than one ``by``, without repeated rows."""
    ends = held.groupBy("bucket").agg(F.min(by).alias("a"), F.max(by).alias("b")).where(F.col("a") < F.col("b")).select("bucket")
    return held.join(ends, "bucket", "left_semi").distinct()


def _may_meet(a: Column, b: Column, similarity: float) -> Column:
    """Whether two members that hold a bucket's element, each ``at`` its place, can be similar and meet by it; see ``_deal``. Null: not dealt."""
    bound = (a["size"] + b["size"]) * ((1 - similarity) / (1 + similarity))
    needed = F.greatest(F.lit(1), F.ceil((a["distance"] + b["distance"] - bound) / 2 - 1e-9))
    return a.isNull() | b.isNull() | ((a["place"] <= a["distance"] - needed + 1) & (b["place"] <= b["distance"] - needed + 1))


def _meet(ranked: DataFrame, sets: DataFrame, width: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Each bucket's leaders, ``bucket, lead``, and their similarity to its members of other components, ``lead, rep, led, comp, sim``.

    Leaders are first by ``place``. Only one of two leaders is compared with the other, and of dealt members those that can be similar.
    """
    at = [F.col("at")] if "at" in ranked.columns else []
    leaders = ranked.withColumn("r", F.row_number().over(Window.partitionBy("bucket").orderBy("place"))).where(F.col("r") <= width)
    leaders = save(leaders.select("bucket", F.col("rep").alias("lead"), F.col("comp").alias("led"), F.col("place").alias("ahead"), *at), "leaders")
    lists = leaders.groupBy("bucket").agg(F.collect_list(F.struct("lead", "led", "ahead", *at)).alias("leads"))
    ahead = F.filter("leads", lambda x: (x["led"] != F.col("comp")) & (x["ahead"] < F.col("place")) & (_may_meet(x["at"], F.col("at"), similarity) if at else F.lit(True)))
    mine = ranked.join(lists, "bucket").select("rep", "comp", F.transform(ahead, lambda x: F.struct(x["lead"].alias("lead"), x["led"].alias("led"))).alias("leads"))
    mine = mine.where(F.size("leads") > 0).groupBy("rep", "comp").agg(F.array_distinct(F.flatten(F.collect_set("leads"))).alias("leads"))
    met = mine.select("rep", "comp", F.explode("leads").alias("l")).select("rep", "comp", "l.*")
    left, right = sets.select("rep", F.col("grams").alias("x")), sets.select(F.col("rep").alias("lead"), F.col("grams").alias("y"))
    compared = met.join(left, "rep").join(right, "lead").select("lead", "rep", "led", "comp", jaccard("x", "y").alias("sim"))
    return leaders, save(compared, "compared")


def _named(members: DataFrame, names: DataFrame) -> DataFrame:
    """``rep, comp`` and other columns with the component's name as of ``names``."""
    names = names.select(F.col("node").alias("comp"), F.col("comp").alias("now"))
    return members.join(names, "comp", "left").withColumn("comp", F.coalesce("now", "comp")).drop("now")


def _left(held: DataFrame, leaders: DataFrame | None, links: DataFrame, dealt: DataFrame | None = None) -> DataFrame:
    """``held`` without its leaders, and ``dealt``, by the components that the links between components make; buckets of several of them.

    A member takes its component's name once, with a list of its buckets, not in each of them.
    Once members have been dealt, ``at`` is what ``_may_meet`` reads.
    """
    at = [F.col("at")] if "at" in held.columns else []
    held = held.select("bucket", "rep", "comp", *at)
    if leaders is not None:
        held = held.join(leaders.select("bucket", F.col("lead").alias("rep")), ["bucket", "rep"], "left_anti")
    names = components(links) if links.take(1) else None
    if names is not None:
        members = held.groupBy("rep", "comp").agg(F.collect_list(F.struct("bucket", *at)).alias("buckets"))
        held = _named(members, names).select(F.explode("buckets").alias("in"), "rep", "comp").select("in.*", "rep", "comp")
    if dealt is not None:
        dealt = dealt.withColumn("comp", F.col("rep"))
        dealt = dealt if names is None else _named(dealt, names)
        dealt = dealt.select(F.explode(F.arrays_zip("keys", "places")).alias("in"), "rep", "comp", "distance", "size")
        dealt = dealt.select(F.col("in.keys").alias("bucket"), "rep", "comp", F.struct(F.col("in.places").alias("place"), "distance", "size").alias("at"))
        held = held.select("bucket", "rep", "comp").unionByName(dealt, allowMissingColumns=True)
    if names is not None:  # written, as what follows reads it twice
        held = save(held, "named")
    return _several(held, "comp")


def _pivots(leaders: DataFrame, compared: DataFrame, degree: DataFrame, buckets: DataFrame) -> DataFrame:
    """``bucket, pivot``: of each of the buckets its leader, or the best connected leader half alike to it.

    Buckets with a common pivot are dealt as one, so that a member of many
    buckets of one group is dealt once.
    """
    firsts = leaders.join(buckets, "bucket", "left_semi").select("bucket", F.col("lead").alias("rep"))
    near = compared.where(F.col("sim") >= 0.5).select("rep", "lead").unionByName(firsts.select("rep", F.col("rep").alias("lead")))
    near = near.join(firsts.select("rep").distinct(), "rep", "left_semi").join(degree.withColumnRenamed("rep", "lead"), "lead")
    roots = near.groupBy("rep").agg((-F.max(F.struct("degree", -F.col("lead")))["col2"]).alias("pivot"))
    return firsts.join(roots, "rep").select("bucket", "pivot")


def deal_keys(own: np.ndarray, common: np.ndarray, times: np.ndarray, pivot: np.ndarray, pivot_common: np.ndarray, pivot_times: np.ndarray, named: int, members: int, similarity: float):
    """A member's similarity to its pivot, its distance, the keys of the buckets that it is dealt to and its places in them; see ``_deal``."""
    extra = ~np.isin(common, pivot, assume_unique=True)
    lost = np.setdiff1d(pivot, own, assume_unique=True)
    both = len(pivot) - len(lost)
    distance = len(own) - both + len(lost)
    # a shingle that the pivot alone has is missing from all others
    at = np.searchsorted(pivot_common, lost)
    held = np.ones(len(lost), np.int64)
    if len(pivot_common):
        known = pivot_common[np.minimum(at, len(pivot_common) - 1)] == lost
        held[known] = pivot_times[at[known]]
    elements = np.concatenate((common[extra], _mix(lost.view(_U) ^ _SEEDS[1]).view(np.int64)))
    rarity = np.concatenate((times[extra], np.maximum(2, members - held)))
    elements = elements[np.lexsort((elements, rarity))].view(_U)
    alone = distance - len(elements)  # shingles of the member alone come first and name no bucket
    alike = both / max(1, len(own) + len(pivot) - both)
    # the least distance of a partner; two that are similar to the pivot need not meet, and who is not has one above far
    slack = len(own) * (1 - similarity) / similarity
    far = (1 - similarity) / (1 + similarity) * (similarity * len(own) + len(pivot)) if alike >= similarity else 0
    least = max(0, distance - slack, far - 1e-6)
    needed = max(1, math.ceil((distance + least - slack) / 2 - 1e-9))
    prefix = max(0, distance - needed + 1 - alone) if least <= distance + slack + 1e-6 else 0
    keys, first = np.unique(_mix(_mix(np.array([named], np.int64).view(_U)) + elements[:prefix]).view(np.int64), return_index=True)
    return alike, distance, keys, (alone + first + 1).astype(np.int32)


def _deal(crowd: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``pivot, rep, sim, distance, size, keys, places``: of members ``pivot, rep`` the similarity to the pivot, and the buckets and places of the pairs that can be similar.

    A member's difference is the set of shingles that it or the pivot has alone.
    Two members differ in what their differences differ in. Texts of n and m
    shingles are similar if that is b = (n + m) (1 - s) / (1 + s) elements at
    most, so their differences, of d and e elements, share (d + e - b) / 2 or
    more. If that is not above 0, both are similar to the pivot, and are linked
    by it. Otherwise they share one of the rarest elements of both: all but as
    many as are needed, less one (prefix filter). A member is in the bucket of
    each element that the least need of any partner leaves to it, once; which
    two of a bucket meet is then told by the need of these two and their places
    of the element (see ``_may_meet``). Rare is by the number of documents with
    a shingle, or of members without it; a shingle that nobody else has names
    no bucket.
    """
    size = crowd.groupBy("pivot").agg(F.count(F.lit(1)).alias("members"))
    mine = sets.select("rep", F.col("grams").alias("x"), F.col("common.gram").alias("xg"), F.col("common.c").alias("xc"))
    theirs = sets.select(F.col("rep").alias("pivot"), F.col("grams").alias("y"), F.col("common.gram").alias("yg"), F.col("common.c").alias("yc"))
    rows = crowd.join(size, "pivot").join(mine, "rep").join(theirs, "pivot")

    def keys(frames):
        for pdf in frames:
            out = []
            for p, members, x, xg, xc, y, yg, yc in zip(*(pdf[c] for c in ("pivot", "members", "x", "xg", "xc", "y", "yg", "yc")), strict=True):
                order = np.argsort(yg, kind="stable")
                out.append(deal_keys(x, xg, xc, np.asarray(y), yg[order], yc[order], p, members, similarity))
            sim, distance, named, places = zip(*out, strict=True) if out else ((), (), (), ())
            yield pd.DataFrame({"pivot": pdf["pivot"], "rep": pdf["rep"], "sim": sim, "distance": distance, "size": [len(x) for x in pdf["x"]], "keys": named, "places": places})
        release()

    return rows.mapInPandas(keys, "pivot long, rep long, sim double, distance int, size int, keys array<bigint>, places array<int>")


def near_duplicates(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    coordinates: int = COORDINATES,
    bands: int = BANDS,
    rows: int = ROWS,
    weighted: bool = True,
    crowd: float = 1.0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``dk, tk, rep, class``: for each row its key, its text's key, its equal texts' and its class's least key.

    Groups are dealt where the rows to compare are more than ``crowd`` times the rows that dealing makes.
    """
    keyed = docs.select(doc_key(F.col(id_col), F.col(text_col)).alias("dk"), text_key(F.col(text_col)).alias("tk"), F.col(text_col).alias("text"))
    signed = save(signatures(keyed, coordinates, bands, rows, weighted), "signatures")

    # 1. equal texts
    reps = save(signed.groupBy("tk").agg(F.min("dk").alias("rep")), "copies")  # written, so that the join can split a text of very many copies
    members = save(signed.select("dk", "tk").join(reps, "tk"), "members")
    bands_of = signed.join(reps, "tk").where(F.col("dk") == F.col("rep")).select("rep", F.explode("bands").alias("bucket"))

    # 2. buckets of several classes, 3. of documents with enough shingles that others have
    held = save(_several(bands_of), "buckets")
    discard(signed)
    sets = shingle_sets(keyed.join(held.select(F.col("rep").alias("dk")).distinct(), "dk", "left_semi"), weighted)
    sets = save(sets.select(F.monotonically_increasing_id().alias("sid"), "rep", "grams"), "shingles")
    sets = save(frequencies(sets).where(F.size("common") >= F.size("grams") * similarity - 1e-9), "shingles")
    held = save(_several(held.join(sets.select("rep").distinct(), "rep", "left_semi")), "buckets")
    sizes = held.groupBy("bucket").agg((F.count(F.lit(1)) - 1).alias("others"))
    degree = save(held.join(sizes, "bucket").groupBy("rep").agg(F.sum("others").alias("degree")), "degrees")
    held = held.withColumn("comp", F.col("rep"))

    # 4. the best connected first
    pairs = docs.sparkSession.createDataFrame([], "a long, b long")
    if held.take(1):
        leaders, compared = _meet(held.join(degree, "rep").withColumn("place", F.struct(-F.col("degree"), "rep")), sets, 1, similarity)
        pairs = compared.where(F.col("sim") >= similarity).select(F.col("lead").alias("a"), F.col("rep").alias("b"))
        held = save(_left(held, leaders, pairs), "buckets")
        held, dealt = _crowded(held, sets, leaders, compared, degree, similarity, crowd)
        if dealt.take(1):
            pairs = save(pairs.union(dealt.where(F.col("sim") >= similarity).select("pivot", "rep")), "links")
            held = save(_left(held.withColumn("comp", F.col("rep")), None, pairs, dealt), "buckets")

    # 5. rounds of leaders
    while held.take(1):
        mates = held.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("mates"))
        leaders, compared = _meet(held.join(mates, ["bucket", "comp"]).withColumn("place", F.struct("mates", "rep")), sets, LEADERS, similarity)
        links = compared.where(F.col("sim") >= similarity)
        pairs = pairs.union(links.select("lead", "rep"))
        held = save(_left(held, leaders, links.select(F.col("led").alias("a"), F.col("comp").alias("b"))), "buckets")

    # 6. components; copies hang on their representative
    same_id = members.groupBy("dk").agg(F.min("rep").alias("b"), F.max("rep").alias("a")).where(F.col("a") != F.col("b")).select("a", "b")
    names = components(pairs.union(same_id))
    out = members.join(names.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select("dk", "tk", "rep", F.coalesce("comp", "rep").alias("class"))


def _crowded(held: DataFrame, sets: DataFrame, leaders: DataFrame, compared: DataFrame, degree: DataFrame, similarity: float, crowd: float) -> tuple[DataFrame, DataFrame]:
    """The buckets that stay as they are, and the members of the others as ``_deal`` has them."""
    sizes = held.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    pivots = save(_pivots(leaders, compared, degree, sizes.select("bucket")).join(sizes, "bucket"), "pivots")
    crowds = save(held.join(pivots, "bucket").where(F.col("rep") != F.col("pivot")).select("pivot", "rep").distinct(), "crowds")
    slack = (1 - similarity) / similarity
    made = crowds.join(sets.select("rep", F.size("grams").alias("n")), "rep").groupBy("pivot").agg((F.sum("n") * (1.5 * slack) * crowd).alias("made"))
    costly = pivots.groupBy("pivot").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs")).join(made, "pivot").where(F.col("pairs") > F.col("made")).select("pivot")
    costly = save(costly, "costly")
    dealt = save(_deal(crowds.join(costly, "pivot", "left_semi"), sets, similarity), "dealt")
    return held.join(pivots.join(costly, "pivot", "left_semi"), "bucket", "left_anti"), dealt


def op2_near_dedup(spark, sf_dir) -> DataFrame:
    """``doc_id, class_id, copy_of``: near-duplicates share a class, equal texts ``copy_of``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select(F.col("dk").alias("doc_id"), F.col("class").alias("class_id"), F.col("rep").alias("copy_of"))


def stage_near_dedup(spark, docs, sf_dir) -> DataFrame:
    """Pipeline stage: of each class the document with the least id stays.

    Of rows with its id one stays: of the least text key, and of equal texts any.
    Columns of any name are kept; null ids, null and empty texts are as in the
    operator; an empty table stays empty.
    """
    found = save(near_duplicates(docs), "classes")
    keep = found.where(F.col("dk") == F.col("class")).groupBy("dk").agg(F.min("tk").alias("tk"), F.count(F.lit(1)).alias("n"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, doc_key(F.col("doc_id"), F.col("text")).alias("dk"), text_key(F.col("text")).alias("tk"))
    kept = keyed.join(keep, ["dk", "tk"])
    if keep.where(F.col("n") > 1).take(1):
        once = kept.where(F.col("n") > 1).dropDuplicates(["dk"])
        kept = kept.where(F.col("n") == 1).unionByName(once)
    return kept.select("row.*")
