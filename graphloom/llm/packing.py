"""Best-fit packing of token ids into sequences of several permitted lengths.

A document's tokens are its token ids and an end id. A document longer than the
largest length is cut into pieces of that length and a rest. Pieces are dealt by
hash into groups of about ``GROUP`` pieces and ``GROUP_TOKENS`` tokens and each
group is packed by best-fit decreasing: a piece goes into the open bin it leaves
fullest; if none can hold it, a bin of the length with the least cost for what
is left to pack is opened. That rule and, for each permitted length, always
opening it are all tried; the least total cost after downsizing, that is after
every bin shrinks to the least permitted length that holds its contents, decides.

Cases: a null or empty text has the end id alone; null ids and repeated rows
are packed like any other; an empty table gives no rows; very long texts are
cut, never shortened; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, save, slices
from .token_binary import END_ID, drop_caches, worker_cache

LENGTHS = (512, 1024, 2048, 4096)
GROUP = 20_000
GROUP_TOKENS = 6_000_000
OUT_ROWS = 256  # pieces whose ids a worker hands over at once, in 8 bytes each


def cost(length: int, largest: int) -> float:
    """In tokens: the sequence itself, attention that grows with its square, a fixed part."""
    return length * (1 + 0.25 * length / largest) + 16


def _pack(sizes: list[int], lengths: tuple[int, ...], opening: int | None) -> tuple[float, list[int], list[int], list[int]]:
    """Sizes descend. Returns the cost, each piece's bin and offset, and the bins' final lengths."""
    largest = lengths[-1]
    costs = [cost(x, largest) for x in lengths]
    rooms: list[list[int]] = [[] for _ in range(largest + 1)]
    some, filled, bins, offsets = 0, [], [], []
    room_of: list[int] = []
    left = sum(sizes)
    for n in sizes:
        fit = some >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                some &= ~(1 << room)
        else:
            if opening is None:
                size = min((c / min(x, left), x) for x, c in zip(lengths, costs, strict=True) if x >= n)[1]
            else:
                size = next(x for x in lengths if x >= max(n, opening))
            b = len(filled)
            filled.append(0)
            room_of.append(size)
            room = size
        bins.append(b)
        offsets.append(filled[b])
        filled[b] += n
        left -= n
        room -= n
        room_of[b] = room
        if room:
            rooms[room].append(b)
            some |= 1 << room
    final = [next(x for x in lengths if x >= f) for f in filled]
    return sum(costs[lengths.index(x)] for x in final), bins, offsets, final


def pack_group(sizes: list[int], lengths: tuple[int, ...]):
    """The cheapest of all opening rules; sizes must descend."""
    return min((_pack(sizes, lengths, o) for o in (None, *lengths)), key=lambda x: x[0])[1:]


def token_pieces(docs: DataFrame, largest: int, id_col: str, text_col: str, tokenizer_path: str | None, end_id: int, tokens: bool) -> DataFrame:
    """``rid, doc_id, piece, first_token, n_tokens, ids``: consecutive pieces of each document's ids, in 4 bytes each; without ``tokens`` no ids."""
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def cut(batches):
        cache = None
        for batch in slices(batches):
            if cache is None:
                cache = worker_cache(tokenizer_path, end_id)
                end = np.array([end_id], cache.dtype).tobytes()
            rid, piece, first, n, ids = [], [], [], [], []
            for at, text in enumerate(batch.column(2).to_pylist()):
                own = np.frombuffer(cache.encode(text) + end, cache.dtype)
                for k, a in enumerate(range(0, len(own), largest)):
                    part = own[a : a + largest]
                    rid.append(at)
                    piece.append(k)
                    first.append(a)
                    n.append(len(part))
                    ids.append(part.astype("<u4").tobytes() if tokens else None)
            at = pa.array(rid, pa.int64())
            columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(piece, pa.int32()), pa.array(first, pa.int64()), pa.array(n, pa.int32()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["rid", "doc_id", "piece", "first_token", "n_tokens", "ids"])

    return rows.mapInArrow(cut, f"rid long, doc_id {kind}, piece int, first_token long, n_tokens int, ids binary")


def pack_batches(batches, lengths: tuple[int, ...], tokens: bool):
    """One group's pieces, packed: record batches, with ``tokens`` of ``OUT_ROWS`` pieces. The ids stay in the given batches until then."""
    held = list(batches)
    rows = pa.Table.from_batches([b.select(["rid", "doc_id", "piece", "first_token", "n_tokens", "g"]) for b in held])
    ids = pa.chunked_array([b.column("ids") for b in held]) if tokens else None
    rows = rows.append_column("at", pa.array(np.arange(rows.num_rows)))
    rows = rows.sort_by([("n_tokens", "descending"), ("rid", "ascending"), ("piece", "ascending")])
    bins, offsets, final = pack_group(rows["n_tokens"].to_pylist(), lengths)
    base = rows["g"][0].as_py() << 32
    columns = {c: rows[c] for c in ("doc_id", "piece", "first_token", "n_tokens")}
    columns |= {"bin": pa.array([base + b for b in bins], pa.int64()), "bin_size": pa.array([final[b] for b in bins], pa.int32()), "offset": pa.array(offsets, pa.int32())}
    out = pa.table(columns)
    step = OUT_ROWS if tokens else out.num_rows
    for a in range(0, out.num_rows, step):
        part = out.slice(a, step)
        if tokens:
            own = np.frombuffer(b"".join([ids[i].as_buffer() for i in rows["at"].slice(a, step).to_pylist()]), "<u4")
            ends = np.concatenate(([0], np.cumsum(part["n_tokens"].to_numpy()))).astype(np.int32)
            part = part.append_column("tokens", pa.ListArray.from_arrays(pa.array(ends), pa.array(own.astype(np.int64))))
        yield from part.combine_chunks().to_batches()


def pack(
    docs: DataFrame,
    lengths=LENGTHS,
    id_col: str = "doc_id",
    text_col: str = "text",
    group: int = GROUP,
    group_tokens: int = GROUP_TOKENS,
    tokenizer_path: str | None = None,
    end_id: int = END_ID,
    tokens: bool = False,
) -> DataFrame:
    """``doc_id, piece, first_token, n_tokens, bin, bin_size, offset``: a row for each piece; with ``tokens`` also its ids."""
    lengths = tuple(sorted(lengths))
    items = save(token_pieces(docs, lengths[-1], id_col, text_col, tokenizer_path, end_id, tokens), "pieces")
    sums = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t")).first()
    groups = max(1, -(-sums["n"] // group), -(-sums["t"] // group_tokens))
    items = items.withColumn("g", F.pmod(F.xxhash64("rid", "piece"), F.lit(groups)))
    kind = dict(items.dtypes)["doc_id"]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        yield from pack_batches(batches, lengths, tokens)
        release()

    schema = f"doc_id {kind}, piece int, first_token long, n_tokens int, bin long, bin_size int, offset int" + (", tokens array<bigint>" if tokens else "")
    return (items if tokens else items.drop("ids")).groupBy("g").applyInArrow(packed, schema)


def sequences(packed: DataFrame, pad_id: int = 0) -> DataFrame:
    """From pieces with tokens, a row for each sequence: ``bin, bin_size, n_tokens, doc_ids, starts, tokens``, padded to ``bin_size``.

    ``starts`` are the places where the pieces begin. A sequence holds ``bin_size`` ids at most.
    """
    part = F.struct("offset", "doc_id", "n_tokens", "tokens")
    out = packed.groupBy("bin", "bin_size").agg(F.sum("n_tokens").cast("int").alias("n_tokens"), F.sort_array(F.collect_list(part)).alias("parts"))
    ids = F.concat(F.flatten("parts.tokens"), F.array_repeat(F.lit(pad_id).cast("long"), F.col("bin_size") - F.col("n_tokens")))
    return out.select("bin", "bin_size", "n_tokens", F.col("parts.doc_id").alias("doc_ids"), F.col("parts.offset").alias("starts"), ids.alias("tokens"))


def op8_best_fit(spark, sf_dir) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def stage_packing(spark, docs, sf_dir) -> DataFrame:
    """Pipeline stage: the packed sequences' contents, a row with its token ids for each piece of a document.

    ``bin`` names the sequence, of ``bin_size`` ids, and ``offset`` the piece's
    place in it; ``sequences`` puts them together. Null and empty texts have the
    end id alone; null ids, repeated rows and very long texts are packed like any
    other; other columns are not read; an empty table gives no rows.
    """
    return pack(docs, tokens=True)
