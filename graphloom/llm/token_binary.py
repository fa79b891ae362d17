"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

Documents are dealt into ranges of ascending ``doc_id``; each range is encoded
and written as three flat little-endian files in one shard folder:

* ``tokens.bin``: token ids, 2 bytes each where the vocabulary allows, else 4
* ``offsets.bin``: int64, n + 1 offsets within the shard's token file
* ``docs.bin``: int64 document ids (``ids.null`` lists the places of null ids)

A shard's base, that is the number of ids in all shards before it, is the
prefix sum over the shards' totals: one number for each range, never for each
document. Files are written under a name of their own for every attempt and
only those a finished task has reported are read, so a lost executor or a
second attempt cannot mix into the result.

Cases: a null text is an empty one (its only id is the end id); null ids come
first; rows with equal ids are ordered by text and kept; an empty table gives
no shard and no row; other columns are not read.
"""

from __future__ import annotations

import json
import os
import sys
import types
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch_path, slices

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
CACHE_WORDS = 600_000
SHORT = 9  # letters; longer words with marks or capitals are put together anew
SHARD_BYTES = 64_000_000  # of text, about
READ_DOCS = 10_000  # documents whose offsets a reader holds at once
READ_BYTES = 32_000_000  # of token ids that a reader holds at once, or one document's
MARKS = ".,;:!?*#%&$)"
LATIN_END = "\u0250"

MANIFEST = T.StructType([
    T.StructField("shard", T.IntegerType()), T.StructField("path", T.StringType()),
    T.StructField("docs", T.LongType()), T.StructField("tokens", T.LongType()),
])


class WordCache(dict):
    """Token bytes by white-space separated word, from the tokenizer itself.

    The tokenizer drops white space and never joins across it, so the ids of a
    text are those of its words in order. It also lower-cases, and splits marks
    from the letters before them; so a word of Latin letters is looked up in
    lower case, and marks behind it (but no apostrophe, which it treats on its
    own) by themselves. A full cache keeps what it has: frequent words come early.
    """

    def __init__(self, tokenizer, dtype: str):
        super().__init__()
        self.tokenizer, self.dtype = tokenizer, dtype

    def __missing__(self, word: str) -> bytes:
        head = word.rstrip(MARKS)
        if head.isalpha() and (head.isascii() or max(head) < LATIN_END and "\u0130" not in head):
            lower = head.lower()
            if lower != word:
                out = self[lower] + self[word[len(head):]]
                if len(word) <= SHORT and len(self) < CACHE_WORDS:
                    self[word] = out
                return out
        out = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype=self.dtype).tobytes()
        if len(self) < CACHE_WORDS:
            self[word] = out
        return out

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


class WholeTexts:
    """Token bytes of whole texts, by any tokenizer."""

    def __init__(self, tokenizer, dtype: str):
        self.tokenizer, self.dtype = tokenizer, dtype

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()


#: Fixed pattern of the pre-tokenizer for which ``WordCache`` holds.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def by_words(tokenizer) -> bool:
    """Whether the tokenizer lower-cases, drops white space and splits as ``WordCache`` assumes."""
    parts = json.loads(tokenizer.to_str())
    norms = [x["type"] for x in (parts["normalizer"] or {}).get("normalizers", ())]
    splits = (parts["pre_tokenizer"] or {}).get("pretokenizers", ())
    split = {"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True}
    return norms == ["NFC", "Replace", "Lowercase"] and bool(splits) and splits[0] == split and [x["type"] for x in splits[1:]] == ["ByteLevel"] and parts["post_processor"] is None


def load_tokenizer(path: str | None = None):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    return Tokenizer.from_file(path)


def worker_cache(tokenizer_path: str | None, end_id: int) -> WordCache | WholeTexts:
    """One cache for all tasks of a worker process, which Spark uses again and again."""
    state = sys.modules.setdefault("_graphloom_worker", types.ModuleType("_graphloom_worker"))
    caches = state.__dict__.setdefault("words", {})
    key = (tokenizer_path, end_id)
    if key not in caches:
        tokenizer = load_tokenizer(tokenizer_path)
        small = max(tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1) <= 65536
        caches.clear()
        caches[key] = (WordCache if by_words(tokenizer) else WholeTexts)(tokenizer, "<u2" if small else "<u4")
    return caches[key]


def drop_caches() -> None:
    """Frees what ``worker_cache`` holds in this process, for tasks that encode nothing."""
    state = sys.modules.get("_graphloom_worker")
    if state is not None:
        state.__dict__.pop("words", None)


def _fs(uri: str):
    """File system and path of a folder; local folders are memory-mapped, others read whole."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


class Ranges:
    """A flat file's values by position: memory-mapped where it is local, else read range by range."""

    def __init__(self, fs, path: str, dtype: str):
        self.dtype = np.dtype(dtype)
        size = fs.get_file_info(path).size
        self.count = size // self.dtype.itemsize
        self.file = None
        if not size:
            self.data = np.zeros(0, self.dtype)
        elif isinstance(fs, pafs.LocalFileSystem):
            self.data = np.memmap(path, dtype=self.dtype, mode="r")
        else:
            self.file, self.data = fs.open_input_file(path), None

    def __getitem__(self, span: slice) -> np.ndarray:
        if self.file is None:
            return self.data[span]
        width = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((span.stop - span.start) * width, span.start * width), self.dtype)


def write_token_files(
    docs: DataFrame,
    folder: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_path: str | None = None,
    end_id: int = END_ID,
    shards: int | None = None,
) -> DataFrame:
    """Encode and write, one shard for about ``SHARD_BYTES`` of text; returns the manifest ``shard, path, docs, tokens, base, first_doc``.

    The manifest holds one row a shard, so it may be collected and broadcast.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    if shards is None:
        sums = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b")).first()
        shards = max(1, -(-(sums["b"] + 16 * sums["n"]) // SHARD_BYTES), min(sums["n"], spark.sparkContext.defaultParallelism))
    dealt = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    dealt = dealt.repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    dealt = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")

    def write(batches):
        from pyspark import TaskContext

        cache, out, totals = None, None, [0, 0]
        for batch in slices(batches):
            if out is None:
                cache = worker_cache(tokenizer_path, end_id)
                dtype = cache.dtype
                fs, root = _fs(folder)
                shard = TaskContext.get().partitionId()
                name = f"{root}/shard-{shard:06d}-{dtype[1:]}-{uuid.uuid4().hex}"
                fs.create_dir(name, recursive=True)
                out = [fs.open_output_stream(f"{name}/{x}.bin") for x in ("tokens", "offsets", "docs")]
                width, end, nulls = int(dtype[-1]), np.array([end_id], dtype).tobytes(), []
                out[1].write(np.zeros(1, "<i8").tobytes())
            ids = batch.column(0)
            for at, (doc, words) in enumerate(zip(ids.to_pylist(), batch.column(1).to_pylist(), strict=True)):
                data = cache.encode(words) + end
                out[0].write(data)
                totals[1] += len(data) // width
                out[1].write(totals[1].to_bytes(8, "little"))
                if doc is None:
                    nulls.append(totals[0])
                out[2].write((doc or 0).to_bytes(8, "little", signed=True))
                totals[0] += 1
        if out is not None:
            for f in out:
                f.close()
            with fs.open_output_stream(f"{name}/ids.null") as f:
                f.write(np.array(nulls, "<i8").tobytes())
            row = [[shard], [name if "://" not in folder else folder.rstrip("/") + name[len(root):]], [totals[0]], [totals[1]]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row[0], pa.int32()), pa.array(row[1], pa.string()), pa.array(row[2], pa.int64()), pa.array(row[3], pa.int64())],
                names=MANIFEST.names,
            )

    rows = sorted(dealt.mapInArrow(write, MANIFEST).collect(), key=lambda r: r["shard"])
    base = first = 0
    out = []
    for r in rows:
        out.append((*r, base, first))
        base, first = base + r["tokens"], first + r["docs"]
    return spark.createDataFrame(out, T.StructType([*MANIFEST, T.StructField("base", T.LongType()), T.StructField("first_doc", T.LongType())]))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: ``doc_id, start, n_tokens, ids_crc32`` (crc over 32-bit ids)."""
    def read(frames):
        for pdf in frames:
            for path, base in zip(pdf["path"], pdf["base"], strict=True):
                fs, root = _fs(path)
                dtype = "<" + root.rsplit("/", 1)[1].split("-")[2]
                tokens = Ranges(fs, f"{root}/tokens.bin", dtype)
                offsets = Ranges(fs, f"{root}/offsets.bin", "<i8")
                docs = Ranges(fs, f"{root}/docs.bin", "<i8")
                empty = Ranges(fs, f"{root}/ids.null", "<i8")
                nulls = set(empty[0 : empty.count].tolist())
                for a in range(0, docs.count, READ_DOCS):
                    b = min(a + READ_DOCS, docs.count)
                    at = np.asarray(offsets[a : b + 1])
                    crc, i = [], 0
                    while i < b - a:
                        j = max(i + 1, int(np.searchsorted(at, at[i] + READ_BYTES // tokens.dtype.itemsize, side="right")) - 1)
                        j = min(j, b - a)
                        part = tokens[int(at[i]) : int(at[j])]
                        crc += [zlib.crc32(part[at[x] - at[i] : at[x + 1] - at[i]].astype("<u4").tobytes()) for x in range(i, j)]
                        i = j
                    yield pd.DataFrame({
                        "doc_id": pd.array([None if a + i in nulls else int(x) for i, x in enumerate(docs[a:b])], dtype="Int64"),
                        "start": at[:-1] + base,
                        "n_tokens": np.diff(at),
                        "ids_crc32": np.array(crc, dtype="int64"),
                    })

    spark = manifest.sparkSession
    n = max(1, manifest.count())
    return manifest.select("path", "base", "shard").repartition(min(n, 10_000), "shard").select("path", "base").mapInPandas(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def op6_token_binary(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read_token_files(write_token_files(docs, scratch_path(spark, "tokens")))
