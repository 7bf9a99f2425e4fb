"""Token ids as flat binary files that are memory-mapped.

A store is a folder with three files per part and one table:

* ``<part>.ids``: ids as little-endian unsigned integers, 16 bits wide where the vocabulary allows it,
  else 32; nothing else is in the file.
* ``<part>.offsets``: documents + 1 little-endian unsigned 64-bit offsets into the part, in ids.
* ``<part>.docs``: the documents' ids as little-endian signed 64-bit integers, in order.
* ``manifest``: a Parquet table with the name, width, document and id counts of every part, how many leading
  documents have a null id, and the part's base, which is the number of ids in all parts before it.

Documents are dealt to the parts by ranges of doc_id and sorted inside them, so parts in order are all
documents in order. A part is written in one task, one Arrow batch after the other, under a name of its own
for every attempt; only names that reached the written manifest count, so a repeated task does no harm.
Bases come from a running sum over the manifest, which has a row per part, not per document.

Defined cases: null and empty texts have only the end id; null doc_ids come first; rows of equal doc_id are in
order of their texts; an empty table gives a store without parts; extra columns are ignored; the string of an added
token in a text is that token, and a text with one is encoded whole."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberwatch.llm.common import new_folder
from emberwatch.llm.library_ids import ChunkEncoder, before_blanks

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
PART_BYTES = 32 << 20  # of text in one part, about
_PART = "part int, name string, width int, n_docs bigint, n_null bigint, n_ids bigint"


class LibraryEncoder(ChunkEncoder):
    """Encodes with the tokenizers library."""

    def __init__(self, path: str):
        super().__init__(path, before_blanks)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4


_ENCODERS: dict[str, LibraryEncoder] = {}


def _encoder(path: str) -> LibraryEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = LibraryEncoder(path)
    return _ENCODERS[path]


def _write_part(batches: Iterator[pa.RecordBatch], folder: str, path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    batches = iter(batches)
    first = next((b for b in batches if b.num_rows), None)
    if first is None:
        return
    own, part = _encoder(path), TaskContext.get().partitionId()
    name = f"part-{part:06d}-{uuid.uuid4().hex}"
    files, root = pafs.FileSystem.from_uri(folder)
    end = end_id.to_bytes(own.width, "little")
    offset = n_docs = n_null = 0
    with (
        files.open_output_stream(f"{root}/{name}.ids") as ids,
        files.open_output_stream(f"{root}/{name}.offsets") as offsets,
        files.open_output_stream(f"{root}/{name}.docs") as docs,
    ):
        offsets.write(np.zeros(1, "<u8").tobytes())
        while first is not None:
            sizes = np.zeros(first.num_rows, dtype="<u8")
            for i, found in enumerate(own.encode(first.column("text"))):
                ids.write(found.astype(f"<u{own.width}").tobytes() + end)
                sizes[i] = len(found) + 1
            total = np.cumsum(sizes, dtype="<u8")
            offsets.write((total + np.uint64(offset)).astype("<u8").tobytes())
            doc = first.column("doc_id").cast(pa.int64())
            docs.write(doc.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            offset, n_docs, n_null = offset + int(total[-1]), n_docs + len(total), n_null + doc.null_count
            first = next((b for b in batches if b.num_rows), None)
    row = {"part": [part], "name": [name], "width": [own.width], "n_docs": [n_docs], "n_null": [n_null], "n_ids": [offset]}
    yield pa.RecordBatch.from_pydict(
        row, schema=pa.schema([("part", pa.int32()), ("name", pa.string()), ("width", pa.int32()),
                               ("n_docs", pa.int64()), ("n_null", pa.int64()), ("n_ids", pa.int64())])
    )


def write_store(
    docs: DataFrame, folder: str | None = None, path: str | None = None,
    end_id: int = END_ID, part_bytes: int = PART_BYTES,
) -> str:
    """Encode all texts and write them in order of doc_id; returns the folder of the store."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "token-store")
    path = path or public_tokenizers.path(TOKENIZER)
    slim = docs.select("doc_id", "text")
    size = slim.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(spark.sparkContext.defaultParallelism, -(-size // part_bytes))
    (
        slim.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
        .mapInArrow(lambda batches: _write_part(batches, folder, path, end_id), _PART)
        .write.parquet(f"{folder}/written")
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    (
        spark.read.schema(_PART).parquet(f"{folder}/written")
        .withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("bigint"))
        .write.parquet(f"{folder}/manifest")
    )
    return folder


def _mapped(files: pafs.FileSystem, path: str, dtype: str) -> np.ndarray:
    """The file's numbers: memory-mapped where the store is a mounted folder, else read."""
    if not files.get_file_info(path).size:
        return np.zeros(0, dtype)
    if isinstance(files, pafs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r")
    with files.open_input_file(path) as data:
        return np.frombuffer(data.read(), dtype)


def _read_part(batches: Iterator[pa.RecordBatch], folder: str, rows: int) -> Iterator[pa.RecordBatch]:
    files, root = pafs.FileSystem.from_uri(folder)
    for batch in batches:
        for part in batch.to_pylist():
            stem = f"{root}/{part['name']}"
            ids = _mapped(files, f"{stem}.ids", f"<u{part['width']}")
            offsets, docs = _mapped(files, f"{stem}.offsets", "<u8").tolist(), _mapped(files, f"{stem}.docs", "<i8")
            for lo in range(0, part["n_docs"], rows):
                at = range(lo, min(lo + rows, part["n_docs"]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([None if i < part["n_null"] else int(docs[i]) for i in at], pa.int64()),
                        pa.array([part["base"] + offsets[i] for i in at], pa.int64()),
                        pa.array([ids[offsets[i]:offsets[i + 1]].astype("<u4").tobytes() for i in at], pa.binary()),
                    ],
                    ["doc_id", "start", "ids"],
                )


def read_store(spark: SparkSession, folder: str, rows: int = 256) -> DataFrame:
    """``(doc_id, start, ids)``: where each document begins among all ids, and its ids (with the end id) as
    little-endian 32-bit integers. Every part is read in its own task."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    parts = manifest.repartitionByRange(max(1, manifest.count()), "part")
    return parts.mapInArrow(lambda batches: _read_part(batches, folder, rows), "doc_id bigint, start bigint, ids binary")


def report(docs: DataFrame) -> DataFrame:
    """Write all documents, read the files back: place, length and CRC-32 of every document's ids."""
    return read_store(docs.sparkSession, write_store(docs)).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )
