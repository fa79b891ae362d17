"""Exact top-k inner-product search by columnar branch and bound.

Vectors become blocks in vertical layout: one array per dimension, plus the
norms of what remains behind every block of dimensions. A query starts from a
lower bound of its k-th best score, found once for each block of queries on a
bounded seed of rows, all of them real candidates. A block of queries
accumulates products with a block of rows dimension block by dimension block;
after each, a query's partial score plus the largest possible remainder (the
product of the remaining norms) must still reach its bound; rows that do so for
no query of the block are dropped and the survivors compacted before the next
dimensions. Bounds only rise, so no answer is lost, ties included.

Blocks of queries meet blocks of rows; both have a fixed number of rows, so a
task's memory is bounded, and neither side is collected or broadcast whole.
Each block of queries is sent once to every lane of ``BLOCKS_PER_LANE`` row blocks.

Cases: vectors that are null, or hold null or non-finite components, take no
part; vectors of different lengths are not compared; repeated rows are separate
candidates (a query leaves out rows of its own id); an id with several distinct
vectors asks with each, and the best pairs of all are its answer; null ids take no part;
ties go to the smaller id; empty tables give no rows; other columns are not
read. Components are ``floor(scale * x)``; one beyond 2^40, or a score that
could be beyond 2^63, is an error.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save

ROWS_PER_BLOCK = 4096
QUERIES_PER_BLOCK = 256
BLOCKS_PER_LANE = 16
SEED_ROWS = 4096
DIM_BLOCK = 16


def _matrix(data: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(data), "<i8").reshape(-1, dim)


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, or the least possible where there are fewer."""
    if scores.shape[1] < k:
        return np.full(scores.shape[0], np.iinfo(np.int64).min)
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products a @ b; by floating point where all sums stay below 2^53."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def _check_range(a: np.ndarray, b: np.ndarray) -> None:
    """Scores are sums over all dimensions: none may pass 64 bits."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] >= 2.0**63:
        raise OverflowError("a score beyond 64 bits is possible")


def search_block(queries: np.ndarray, qids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray):
    """Yield ``(query position, ids, scores)`` of one block's best k for each query."""
    dim = rows.shape[1]
    _check_range(queries, rows)
    order = np.argsort(-np.abs(rows.astype(np.float64)).sum(axis=0), kind="stable")
    cols = np.ascontiguousarray(rows[:, order].T)  # vertical: one array a dimension
    q = np.ascontiguousarray(queries[:, order])
    cuts = [*range(0, dim, DIM_BLOCK), dim]
    ends = cuts[1:]

    def rest(m):  # norms of what is behind each cut, a little too large rather than too small
        squares = np.cumsum((m.astype(np.float64) ** 2)[::-1], axis=0)[::-1]
        return [np.sqrt(squares[c]) * (1 + 1e-9) if c < dim else np.zeros(m.shape[1]) for c in ends]

    behind, qbehind = rest(cols), rest(np.ascontiguousarray(q.T))
    least = np.iinfo(np.int64).min
    live, part = np.arange(len(ids)), np.zeros((len(q), len(ids)), np.int64)
    own = qids[:, None] == ids[None, :]
    bound = floor.copy()
    for b, end in enumerate(ends):
        part += _exact(q[:, cuts[b] : end], cols[cuts[b] : end][:, live])
        if end == dim:
            break
        most = np.ceil(qbehind[b][:, None] * behind[b][live][None, :]).astype(np.int64) + 1
        if part.shape[1] >= k:
            sure = np.where(own, least, part - most)
            bound = np.maximum(bound, _kth(sure, k))
        keep = ((part + most >= bound[:, None]) & ~own).any(axis=0)
        if not keep.all():
            live, part, own = live[keep], np.ascontiguousarray(part[:, keep]), own[:, keep]
    part[own] = least
    top = _kth(part, k) if part.shape[1] > k else np.full(len(q), least)
    good = (part >= np.maximum(np.maximum(top, bound), least + 1)[:, None]) & ~own
    for j in np.flatnonzero(good.any(axis=1)):
        at = np.flatnonzero(good[j])
        best = at[np.lexsort((ids[live[at]], -part[j][at]))[:k]]
        yield j, ids[live[best]], part[j][best]


def _good(id_col: str, vec_col: str):
    return F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & F.forall(
        F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    )


def pack(vectors: DataFrame, id_col: str, vec_col: str, scale: int, per_block: int) -> DataFrame:
    """Blocks of integer vectors: ``dim, block, ids, data``, a few blocks a partition left short."""
    rows = vectors.where(_good(id_col, vec_col)).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))

    def build(frames):
        for pdf in frames:
            size = pdf["v"].map(len)
            for dim, group in pdf.groupby(size):
                m = np.floor(scale * np.array(group["v"].tolist(), dtype=np.float64).reshape(len(group), dim))
                if np.abs(m).max(initial=0) > 2.0**40:
                    raise OverflowError("a component beyond 2^40 after scaling")
                m, ids = m.astype("<i8"), group["id"].to_numpy("<i8")
                for a in range(0, len(ids), per_block):
                    yield pd.DataFrame({"dim": [dim], "ids": [ids[a : a + per_block].tobytes()], "data": [m[a : a + per_block].tobytes()]})

    return rows.mapInPandas(build, "dim int, ids binary, data binary")


def top_k(
    vectors: DataFrame,
    is_query,
    k: int = 10,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    scale: int = 1024,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k best rows of another id."""
    spark = vectors.sparkSession
    rows = save(pack(vectors, id_col, vec_col, scale, ROWS_PER_BLOCK).withColumn("block", F.monotonically_increasing_id()), "row-blocks")
    # equal rows of an id are one query
    asked = vectors.where(is_query & _good(id_col, vec_col)).select(id_col, vec_col).distinct()
    asked = save(pack(asked, id_col, vec_col, scale, QUERIES_PER_BLOCK), "query-blocks")
    asked = save(_with_floors(asked, rows, k), "query-blocks")

    # row blocks are dealt into lanes; each query block goes to every lane
    lanes = max(1, -(-rows.count() // BLOCKS_PER_LANE))
    lane = F.pmod(F.xxhash64("block"), F.lit(lanes))
    blocks = rows.select("dim", lane.alias("lane"), F.col("ids").alias("r_ids"), F.col("data").alias("r_data"))
    sent = asked.select("dim", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), "floors", F.explode(F.sequence(F.lit(0), F.lit((lanes - 1) // 1000))).alias("part"))
    sent = sent.withColumn("lane", F.explode(F.sequence(F.col("part") * 1000, F.least(F.col("part") * 1000 + 999, F.lit(lanes - 1)))))
    met = blocks.join(sent.withColumn("lane", F.col("lane").cast("long")), ["lane", "dim"]).select("dim", "r_ids", "r_data", "q_ids", "q_data", "floors")

    def search(frames):
        for pdf in frames:
            for dim, r_ids, r_data, q_ids, q_data, floor in pdf.itertuples(index=False):
                ids, qids = np.frombuffer(r_ids, "<i8"), np.frombuffer(q_ids, "<i8")
                found = list(search_block(_matrix([q_data], dim), qids, _matrix([r_data], dim), ids, k, np.frombuffer(floor, "<i8")))
                if found:
                    yield pd.DataFrame({
                        "query_id": np.repeat([qids[j] for j, _, _ in found], [len(x) for _, x, _ in found]),
                        "vec_id": np.concatenate([x for _, x, _ in found]),
                        "score": np.concatenate([s for _, _, s in found]),
                    })

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = met.mapInPandas(search, "query_id long, vec_id long, score long")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _with_floors(asked: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Query blocks with ``floors``, each query's first lower bound, from a bounded seed of rows."""
    seed = rows.orderBy("block").limit(max(1, SEED_ROWS // ROWS_PER_BLOCK)).collect()
    held = asked.sparkSession.sparkContext.broadcast([(r["dim"], bytes(r["ids"]), bytes(r["data"])) for r in seed])

    def floors(frames):
        for pdf in frames:
            out = []
            for dim, q_ids, q_data in zip(pdf["dim"], pdf["ids"], pdf["data"], strict=True):
                q, qids = _matrix([q_data], dim), np.frombuffer(q_ids, "<i8")
                least = np.full(len(q), np.iinfo(np.int64).min)
                for d, ids, data in held.value:
                    if d == dim:
                        rows_of = _matrix([data], dim)
                        _check_range(q, rows_of)
                        scores = _exact(q, rows_of.T)
                        scores[qids[:, None] == np.frombuffer(ids, "<i8")[None, :]] = np.iinfo(np.int64).min
                        least = np.maximum(least, _kth(scores, k))
                out.append(least.astype("<i8").tobytes())
            yield pdf.assign(floors=out)

    return asked.mapInPandas(floors, "dim int, ids binary, data binary, floors binary")


def op9_top_k(spark, sf_dir) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
             CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10
"""
