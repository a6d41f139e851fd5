"""Token counts of flat token files by separator scan.

A flat file is a run of fixed-width token ids with an end-of-document id after each document, and no index. Files are
held as rows of blocks (file, block, tokens): a block is cut anywhere, so a document may span many. Every block is
searched for the separator at once (one vectorised comparison) and yields its separators' positions; a prefix scan over
the blocks' lengths and separator counts, in two levels so that no file is one task's work, makes positions and
ordinals global, and a document's count is the distance to the separator before. What follows a file's last separator is
a last document, if it isn't empty.

An empty block adds nothing; missing block numbers are no gap. Empty documents count 0. Null blocks count as empty.
"""

from __future__ import annotations

import base64
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.llm.common import materialize, slices, utf8

#: The pattern that cuts text before byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Blocks summed together at the lower level of the prefix scan.
CHUNK = 1024


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _packed(ranks, end: int, block_tokens: int, dtype: str):
    """Tokenizes a partition's documents to one flat file of ids, in blocks."""

    def packed(batches):
        import tiktoken
        from pyspark import TaskContext

        tokenizer = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks.value, special_tokens={})
        file, block, rest = TaskContext.get().partitionId(), 0, np.empty(0, dtype)
        ordinal = 0
        for b in batches:
            data, starts = utf8(b.column(b.schema.get_field_index("text")))
            ids = b.column(b.schema.get_field_index("doc_id"))
            for at, to in slices(starts):  # a slice's tokens are sent on before the next slice's are made
                parts = [rest]
                for i, j in zip(starts[at:to], starts[at + 1 : to + 1]):
                    parts.append(np.array([*tokenizer.encode_ordinary(data[i:j].tobytes().decode("utf-8", "replace")), end], dtype))
                rest = np.concatenate(parts)
                whole, n = len(rest) // block_tokens, to - at
                yield pa.RecordBatch.from_pydict({"file": [file] * (whole + n), "block": [*range(block, block + whole), *[None] * n], "tokens": [rest[k * block_tokens : (k + 1) * block_tokens].tobytes() for k in range(whole)] + [None] * n, "ordinal": [None] * whole + [*range(ordinal, ordinal + n)], "doc_id": [None] * whole + ids[at:to].to_pylist()}, _PACKED)
                block, ordinal, rest = block + whole, ordinal + n, rest[whole * block_tokens :].copy()
        if len(rest):
            yield pa.RecordBatch.from_pydict({"file": [file], "block": [block], "tokens": [rest.tobytes()], "ordinal": [None], "doc_id": [None]}, _PACKED)

    return packed


_PACKED = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("tokens", pa.binary()), ("ordinal", pa.int64()), ("doc_id", pa.int64())])


def flat_files(docs: DataFrame, ranks: dict[bytes, int], end: int = 50256, block_tokens: int = 1 << 18, dtype: str = "<u2", doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Tokenizes documents to flat files, one of each partition. Returns blocks (file, block, tokens) and the order in
    which documents were written (file, ordinal, doc_id), which the files themselves don't tell."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # a tokenizer's vocabulary, of fixed size
    both = materialize(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_packed(shared, end, block_tokens, dtype), "file long, block long, tokens binary, ordinal long, doc_id long"))
    return both.where("block IS NOT NULL").select("file", "block", "tokens"), both.where("ordinal IS NOT NULL").select("file", "ordinal", "doc_id")


def _ranges(block_bytes: int):
    def read(batches):
        for b in batches:
            for file, path, block in zip(*(b.column(c).to_pylist() for c in ("file", "path", "block"))):
                if path.startswith("file:"):
                    system, inner = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
                else:
                    system, inner = fs.FileSystem.from_uri(quote(path, safe="/:@"))
                with system.open_input_file(inner) as f:
                    f.seek(block * block_bytes)
                    yield pa.RecordBatch.from_pydict({"file": [file], "block": [block], "tokens": [f.read(block_bytes)]}, pa.schema([("file", pa.int64()), ("block", pa.int64()), ("tokens", pa.binary())]))

    return read


def read_files(spark: SparkSession, path: str, block_bytes: int = 1 << 20) -> DataFrame:
    """Flat files of a folder as rows of blocks. Spark lists them; each task reads its own byte ranges, so a file of any size is many tasks' work."""
    files = spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("file"), "path", "length")
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.floor((F.col("length") - 1) / block_bytes))))
    return files.select("file", "path", at.alias("block")).repartition("file", "block").mapInArrow(_ranges(block_bytes), "file long, block long, tokens binary")


def _searched(end: int, dtype: str):
    def searched(batches):
        for b in batches:
            if not b.num_rows:
                continue
            data, starts = _bytes(b.column(b.schema.get_field_index("tokens")))
            width = np.dtype(dtype).itemsize
            n, at = [], []
            for i, j in zip(starts[:-1], starts[1:]):
                own = np.frombuffer(data[i:j].tobytes(), dtype)
                n.append((j - i) // width)
                at.append(np.flatnonzero(own == end).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("file")), b.column(b.schema.get_field_index("block")), pa.array(n, pa.int64()), pa.array(at, pa.list_(pa.int64()))], ["file", "block", "n", "at"])

    return searched


def _bytes(column) -> tuple[np.ndarray, np.ndarray]:
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, where, data = column.buffers()
    starts = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return held[starts[0] : starts[-1]], starts - starts[0]


def count(blocks: DataFrame, end: int = 50256, dtype: str = "<u2") -> DataFrame:
    """Rows (file, ordinal, n_tokens): the documents of flat files, in order, without their separators."""
    found = materialize(blocks.select("file", "block", "tokens").mapInArrow(_searched(end, dtype), "file long, block long, n long, at array<long>").withColumn("chunk", F.floor(F.col("block") / CHUNK)))
    # Prefix scan: tokens and separators before each block, and where the last separator before it stands.
    sums = found.select("file", "chunk", "block", "n", F.size("at").cast("long").alias("seps"), F.when(F.size("at") > 0, F.element_at("at", -1)).alias("last"))
    inside = Window.partitionBy("file", "chunk").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    local = sums.withColumns({"t0": F.coalesce(F.sum("n").over(inside), F.lit(0)), "s0": F.coalesce(F.sum("seps").over(inside), F.lit(0))})
    local = local.withColumn("l0", F.max(F.col("t0") + F.col("last")).over(inside))
    chunks = local.groupBy("file", "chunk").agg(F.sum("n").alias("ct"), F.sum("seps").alias("cs"), F.max(F.col("t0") + F.col("last")).alias("cl"))
    above = Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumns({"t1": F.coalesce(F.sum("ct").over(above), F.lit(0)), "s1": F.coalesce(F.sum("cs").over(above), F.lit(0))})
    chunks = chunks.withColumn("l1", F.max(F.col("t1") + F.col("cl")).over(above))
    base = local.join(chunks.select("file", "chunk", "t1", "s1", "l1"), ["file", "chunk"])
    base = base.select("file", "block", "n", (F.col("t0") + F.col("t1")).alias("t"), (F.col("s0") + F.col("s1")).alias("s"), F.coalesce(F.col("l0") + F.col("t1"), "l1", F.lit(-1)).alias("l"))
    done = found.select("file", "block", "at").where(F.size("at") > 0).join(base, ["file", "block"])
    lengths = F.zip_with("at", F.concat(F.array(F.col("l") - F.col("t")), F.slice("at", 1, F.greatest(F.size("at") - 1, F.lit(0)))), lambda a, b: a - b - 1)
    docs = done.select("file", "s", F.posexplode(lengths).alias("i", "n_tokens")).select("file", (F.col("s") + F.col("i")).alias("ordinal"), "n_tokens")
    tail = base.groupBy("file").agg(F.max(F.struct("block", "t", "n", "s", "l")).alias("b")).select("file", "b.*")
    ends = found.select("file", "block", F.size("at").cast("long").alias("seps"), F.when(F.size("at") > 0, F.element_at("at", -1)).alias("last")).join(tail, ["file", "block"])
    ends = ends.select("file", (F.col("s") + F.col("seps")).alias("ordinal"), (F.col("t") + F.col("n") - F.coalesce(F.col("t") + F.col("last"), "l") - 1).alias("n_tokens")).where("n_tokens > 0")
    return docs.union(ends)
