"""Token ids in Arrow files of fixed-size lists, for zero-copy random access to equal-length sequences.

Documents go in ascending id order (null ids first, repeated ids by text) into one file per range of ids.  A
file holds batches of ``batch_sequences`` rows (the last may be shorter), each row a sequence of exactly
``seq_len`` ids and its mask, so sequence i is row ``i % batch_sequences`` of batch ``i // batch_sequences``
and a memory map serves it without a copy.  A document's ids follow each other across sequences; only the
end of a file is padded, with a false mask.  Beside it lies an index file: id, start and n_tokens of each
document.  Ids take 16 bits where the vocabulary allows it.

Every attempt of a task writes files of its own name; the manifest, which Spark commits, names those of the
attempts that count, so a lost executor or a repeated task does no harm.

Defined results: a null or empty text is the end id alone; an empty table gives no files and no rows; other
columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import runtime as R
from .tokens import encode, pieces, vocabulary

END_ID = 2


def _open(uri: str, mode: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    if mode == "w":
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        return system.open_output_stream(path)
    return pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path)


class _Writer:
    """One shard: collects ids and writes whole batches of sequences."""

    def __init__(self, uri: str, dtype: np.dtype, seq_len: int, batch_sequences: int, id_type: pa.DataType):
        self.seq_len, self.room, self.dtype = seq_len, seq_len * batch_sequences, dtype
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(pa.field("item", kind, False), seq_len)), ("mask", pa.list_(pa.field("item", pa.bool_(), False), seq_len))])
        self.index_schema = pa.schema([("doc_id", id_type), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = [_open(uri, "w"), _open(uri + ".index", "w")]
        self.data, self.index = pa.ipc.new_file(self.sinks[0], self.schema), pa.ipc.new_file(self.sinks[1], self.index_schema)
        self.held, self.n_held, self.total, self.docs = [], 0, 0, 0

    def add(self, ids: pa.Array, encoded: list[bytes]) -> None:
        lengths = np.array([len(x) // 4 for x in encoded], np.int64)
        starts = self.total + np.cumsum(lengths) - lengths
        self.index.write_batch(pa.RecordBatch.from_arrays([ids, pa.array(starts), pa.array(lengths)], schema=self.index_schema))
        self.held.append(np.frombuffer(b"".join(encoded), "<u4").astype(self.dtype))
        self.n_held += int(lengths.sum())
        self.total += int(lengths.sum())
        self.docs += len(encoded)
        if self.n_held >= self.room:
            flat = np.concatenate(self.held)
            whole = len(flat) // self.room * self.room
            for k in range(0, whole, self.room):
                self._write(flat[k : k + self.room], self.room)
            self.held, self.n_held = [flat[whole:]], len(flat) - whole

    def _write(self, flat: np.ndarray, n: int) -> None:
        rows = -(-n // self.seq_len)
        ids = np.zeros(rows * self.seq_len, self.dtype)
        ids[:n] = flat
        mask = np.arange(len(ids)) < n
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(v), type=f.type) for v, f in zip((ids, mask), self.schema, strict=True)]
        self.data.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.n_held:
            self._write(np.concatenate(self.held), self.n_held)
        for x in (self.data, self.index, *self.sinks):
            x.close()


def _write_shards(folder: str, vocab: str, end_id: int, seq_len: int, batch_sequences: int):
    def write(batches):
        writer = uri = None
        for batch in batches:
            if not len(batch):
                continue
            if writer is None:
                small = pieces(vocab).tokenizer.get_vocab_size() <= 1 << 16
                uri = f"{folder}/tokens-{uuid.uuid4().hex}.arrow"
                writer = _Writer(uri, np.dtype("<u2" if small else "<u4"), seq_len, batch_sequences, batch.schema.field("_id").type)
            for k in range(0, len(batch), 500):
                part = batch.slice(k, 500)
                writer.add(part.column("_id"), encode(vocab, part.column("_text").to_pylist(), end_id))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"shard": TaskContext.get().partitionId(), "uri": uri, "n_docs": writer.docs, "n_tokens": writer.total}])

    return write


def write_tokens(docs: DataFrame, folder: str, vocab: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, seq_len: int = 1024, batch_sequences: int = 256) -> DataFrame:
    """Write the files; the manifest: shard (ascending with the ids), uri, n_docs, n_tokens, first_token."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("_tie", F.xxhash64("_text"))
    order = [F.col("_id").asc_nulls_first(), F.col("_tie")]  # rows of one id, or without id, may fall to several files
    ordered = texts.repartitionByRange(*order).sortWithinPartitions(*order, "_text").drop("_tie")
    shards = ordered.mapInArrow(_write_shards(folder, vocab, end_id, seq_len, batch_sequences), "shard long, uri string, n_docs long, n_tokens long")
    rows = R.materialize(shards, "token-manifest").orderBy("shard").collect()  # a row per file
    first, out = 0, []
    for r in rows:
        out.append((r.shard, r.uri, r.n_docs, r.n_tokens, first))
        first += r.n_tokens
    return spark.createDataFrame(out, "shard long, uri string, n_docs long, n_tokens long, first_token long")


def sequence(uri: str, i: int, batch_sequences: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Ids (a view of the mapped file) and mask of sequence i of a file."""
    batch = pa.ipc.open_file(_open(uri, "r")).get_batch(i // batch_sequences)
    ids, mask = (batch.column(c).slice(i % batch_sequences, 1).flatten() for c in ("ids", "mask"))
    return ids.to_numpy(zero_copy_only=True), mask.to_numpy(zero_copy_only=False)


def read_documents(uri: str) -> Iterator[tuple[pa.RecordBatch, list[list[np.ndarray]]]]:
    """The index of a file, batch by batch, with each document's ids as one or more pieces, read in order."""
    data, index = pa.ipc.open_file(_open(uri, "r")), pa.ipc.open_file(_open(uri + ".index", "r"))
    number, base, flat = -1, 0, np.zeros(0, np.uint16)
    for k in range(index.num_record_batches):
        batch = index.get_batch(k)
        documents = []
        for start, n in zip(batch.column("start").to_pylist(), batch.column("n_tokens").to_pylist(), strict=True):
            parts, at = [], start
            while at < start + n:
                while at >= base + len(flat):
                    base, number = base + len(flat), number + 1
                    flat = data.get_batch(number).column("ids").flatten().to_numpy(zero_copy_only=True)
                parts.append(flat[at - base : start + n - base])
                at += len(parts[-1])
            documents.append(parts)
        yield batch, documents


def _digest(batches):
    for batch in batches:
        for uri, first in zip(batch.column("uri").to_pylist(), batch.column("first_token").to_pylist(), strict=True):
            for index, documents in read_documents(uri):
                crcs = []
                for parts in documents:
                    crc = 0
                    for p in parts:
                        crc = zlib.crc32(p.astype("<u4").tobytes(), crc)
                    crcs.append(crc)
                starts = np.asarray(index.column("start")) + first
                yield pa.RecordBatch.from_arrays([index.column("doc_id"), pa.array(starts), index.column("n_tokens"), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def digests(manifest: DataFrame, id_type: T.DataType, id_col: str = "doc_id") -> DataFrame:
    """Per document, from the files: id, start in the whole stream, n_tokens, crc32 of its ids as 32-bit integers."""
    schema = T.StructType([T.StructField("doc_id", id_type), *[T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32")]])
    n = max(1, manifest.count())
    return manifest.repartitionByRange(n, "shard").mapInArrow(_digest, schema).withColumnRenamed("doc_id", id_col)


def token_digests(docs: DataFrame, vocab_name: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files to the shared folder and read them back."""
    folder = R.scratch_path(docs.sparkSession, "token-files")
    manifest = write_tokens(docs, folder, vocabulary(vocab_name), id_col, text_col)
    return digests(manifest, docs.schema[id_col].dataType, id_col)
