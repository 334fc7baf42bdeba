"""Token ids of documents, in order, written to and read from files of segments of `codec`."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .codec import BLOCK, Segment, decode, encode
from .common import doc_texts, give_back, offsets_of, partitions, read, shared_dir, slices, small_batches, stage
from .tokens import encoder, vocabulary

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
#: A segment is closed by the document that brings it to so many ids.
SEGMENT = 4096 * BLOCK

WRITTEN = "part int, place int, before long, n_ids long, path string"


def _put(folder: str, name: str, data: bytes) -> str:
    """Writes a file by another name first: a file of the right name is whole, whoever wrote it, and a task run anew replaces it by the same."""
    where, base = fs.FileSystem.from_uri(folder)
    where.create_dir(base, recursive=True)
    own = f"{base}/.{name}.{uuid.uuid4().hex}"
    with where.open_output_stream(own) as out:
        out.write(data)
    where.move(own, f"{base}/{name}")
    return f"{folder}/{name}"


def _get(path: str) -> bytes:
    where, name = fs.FileSystem.from_uri(path)
    with where.open_input_stream(name) as file:
        return file.read()


def write(docs: DataFrame, path: str | None = None, end_id: int = END_ID, folder: str | None = None) -> DataFrame:
    """Writes docs to files of the format and returns their list: part and place give their order, before the ids of the part before them.

    Documents are in ascending doc_id (null first), ties by CRC-32 of the text; a null or empty text
    is the end id alone, a long one lies in one file, whole. Repeated rows are written each by itself.
    No file: an empty table. Columns besides doc_id and text, whatever their names, are ignored.
    A file has the ids of whole documents; a lost task writes its files anew, in the same folder,
    a new one in the shared folder unless named.
    """
    spark = docs.sparkSession
    into = folder or f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    rows = doc_texts(docs).withColumn("__tie", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    laid = rows.repartitionByRange(partitions(spark), "doc_id", "__tie").sortWithinPartitions("doc_id", "__tie").select("doc_id", "text")
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, end, part = encoder(path or vocabulary(VOCABULARY), True), np.array([end_id], np.uint32), TaskContext.get().partitionId()
        place, before, have, parts, doc_ids, lengths = 0, 0, 0, [], [], []

        def segment() -> pa.RecordBatch:
            file = _put(into, f"{part:06d}-{place:06d}.qti", encode(np.concatenate(parts), doc_ids, lengths))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([place], pa.int32()), pa.array([before], pa.int64()), pa.array([have], pa.int64()), pa.array([file])], ["part", "place", "before", "n_ids", "path"])

        for b in slices(batches):
            for doc, x in zip(b.column(0).to_pylist(), enc.encode(b.column(1)), strict=True):
                parts += (x, end)
                doc_ids.append(doc)
                lengths.append(len(x) + 1)
                have += lengths[-1]
                if have >= SEGMENT:
                    yield segment()
                    place, before, have, parts, doc_ids, lengths = place + 1, before + have, 0, [], [], []
        if doc_ids:
            yield segment()
        give_back()

    return stage(laid.mapInArrow(run, WRITTEN), "token-files")


def read_back(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from what the files hold; a damaged file is an error."""
    # one number for each part
    before = offsets_of(files.groupBy("part").agg(F.sum("n_ids").alias("n")), "part", "n")
    placed = files.join(F.broadcast(before), F.col("part") == F.col("__part")).select((F.col("__offset") + F.col("before")).alias("start"), "path")
    # a row stands for a file of some megabytes, so rows are dealt one by one
    placed = placed.repartitionByRange(4 * partitions(files.sparkSession), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, path in zip(*b.columns, strict=True):  # one file at a time
                ids, doc_ids, lengths = decode(_get(path.as_py()))
                ends = np.cumsum(lengths.astype(np.int64))
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(ends - lengths + start.as_py(), pa.int64()), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
        give_back()

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_block(path: str, block: int) -> np.ndarray:
    """The ids of one block of a file, whatever became of the others; ValueError if its own check fails."""
    (ids,) = Segment(_get(path)).read([block])
    if ids is None:
        raise ValueError(f"block {block} of {path} is damaged")
    return ids


def op5_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(write(read(spark, sf_dir, "documents")))
