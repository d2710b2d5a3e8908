"""Token counts from flat token files without an index.

A token file is nothing but ids, little-endian, one end-of-document id after each document. A scan
cuts every file into blocks, searches each block for the end-of-document id with one vectorised
comparison, and returns for each end the tokens since the last end in the block, plus the tail after the
last. A prefix scan over the tails of a file's blocks gives what is carried into each block, and
stitches documents across block boundaries, however many blocks they span.

Files are written by tasks into the shared folder through the file system that its address names;
a task that runs again writes a new file, and only files named in the committed listing are read.

Defined results: a null or empty text has 0 tokens, repeated rows are documents of their own, doc_id may be null, other columns are
ignored, an empty table gives an empty one. A very long text is encoded as a whole by its task and its ids may span any number of blocks. A file whose last
document lacks its end counts it as a document too.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.bpe import read_ranks
from larder.llm.common import shared_dir, stored, bound_batches

#: Bytes of a block of a scan, documents encoded at once, and bytes after which a task begins another file.
BLOCK_BYTES, ENCODE_DOCS, FILE_BYTES = 4 << 20, 64, 256 << 20


def _open(address: str):  # noqa: ANN202
    from pyarrow import fs

    return fs.FileSystem.from_uri(address if "://" in address else f"file://{address}")


def _written(ranks_path: str, pattern: str, end_id: int, folder: str):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoding = tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={})
        width = "<u2" if end_id < 2**16 else "<u4"
        end = np.array([end_id], width).tobytes()
        system, path = _open(folder)
        out, name, size, place = None, "", 0, 0
        for batch in batches:
            places, names = [], []
            for at in range(0, len(batch), ENCODE_DOCS):
                for text in batch.column(1).slice(at, ENCODE_DOCS).to_pylist():
                    if out is None or size >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, size, place = f"{uuid.uuid4().hex}.tokens", 0, 0
                        out = system.open_output_stream(f"{path}/{name}")
                    raw = np.array(encoding.encode_ordinary(text or ""), width).tobytes() + end
                    out.write(raw)
                    size += len(raw)
                    names.append(name)
                    places.append(place)
                    place += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(places, pa.int64())], ["doc_id", "file", "place"])
        if out is not None:
            out.close()

    return run


def write_token_files(docs: DataFrame, folder: str, ranks_path: str, pattern: str, end_id: int) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text) to flat files below ``folder``; (doc_id, file, place in the file)."""
    bound_batches(docs.sparkSession)
    system, path = _open(folder)
    system.create_dir(path, recursive=True)
    docs = docs.select("doc_id", "text")
    return stored(docs.mapInArrow(_written(ranks_path, pattern, end_id, folder), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, file string, place long"), "token-listing")


def _scanned(folder: str, end_id: int, width: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _open(folder)
        for batch in batches:
            # One row at a time: a block of nothing but ends has as many counts as ids.
            for at, (name, block) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                with system.open_input_file(f"{path}/{name}") as file:
                    raw = file.read_at(min(BLOCK_BYTES, file.size() - block * BLOCK_BYTES), block * BLOCK_BYTES)
                ends = np.flatnonzero(np.frombuffer(raw, f"<u{width}") == end_id)
                counts = pa.ListArray.from_arrays(pa.array([0, len(ends)], pa.int32()), pa.array(np.diff(ends, prepend=-1) - 1, pa.int64()))
                tail = len(raw) // width - (int(ends[-1]) + 1 if len(ends) else 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1), batch.column(1).slice(at, 1), counts, pa.array([tail], pa.int64())], ["file", "block", "counts", "tail"])

    return run


def scan_token_files(files: DataFrame, folder: str, end_id: int, width: int) -> DataFrame:
    """(file, place, n_tokens) of every document in ``files`` (file, bytes)."""
    bound_batches(files.sparkSession)
    blocks = files.where("bytes > 0").select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(bytes - 1) div {BLOCK_BYTES}"))).alias("block"))
    found = blocks.repartition("file", "block").mapInArrow(_scanned(folder, end_id, width), "file string, block long, counts array<long>, tail long")
    in_order = Window.partitionBy("file").orderBy("block")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    # The prefix scan: places passed and tokens carried, restarting at the last block that had an end.
    found = found.withColumn("passed", F.coalesce(F.sum(F.size("counts")).over(before), F.lit(0)))
    found = found.withColumn("tails", F.coalesce(F.sum("tail").over(before), F.lit(0)))
    restart = F.coalesce(F.last(F.when(F.size("counts") > 0, F.col("tails")), ignorenulls=True).over(before), F.lit(0))
    found = found.withColumn("carried", F.col("tails") - restart).withColumn("last", F.lead("block").over(in_order).isNull())
    stitched = F.transform("counts", lambda n, i: F.when(i == 0, n + F.col("carried")).otherwise(n))
    left = F.when(F.col("last") & (F.when(F.size("counts") > 0, F.col("tail")).otherwise(F.col("tail") + F.col("carried")) > 0), F.array(F.when(F.size("counts") > 0, F.col("tail")).otherwise(F.col("tail") + F.col("carried")))).otherwise(F.array().cast("array<long>"))
    return found.select("file", "passed", F.posexplode(F.concat(stitched, left)).alias("i", "n_tokens")).select("file", (F.col("passed") + F.col("i")).alias("place"), "n_tokens")


def token_counts(docs: DataFrame, ranks_path: str, pattern: str, end_id: int) -> DataFrame:
    """doc_id and n_tokens of every row of ``docs`` (doc_id, text), by way of flat token files."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    listing = write_token_files(docs, folder, ranks_path, pattern, end_id)
    sizes = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes")) if not listing.isEmpty() else spark.createDataFrame([], "file string, bytes long")
    committed = sizes.join(listing.select("file").distinct(), "file", "left_semi")
    found = scan_token_files(committed, folder, end_id, 2 if end_id < 2**16 else 4)
    # The listing grows with the documents however small its files are, so it is never to be broadcast.
    return listing.hint("merge").join(found, ["file", "place"]).select("doc_id", "n_tokens")
