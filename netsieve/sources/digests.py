"""Digests of whole files, read piece by piece, so that a file of any size needs one small buffer."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from netsieve.session import shuffle_width

PIECE_BYTES = 8 << 20


def arrow_uri(path: str) -> str:
    """Arrow wants the empty host that Spark leaves out of local paths."""
    return "file:///" + path[5:].lstrip("/") if path.startswith("file:") else path


def file_digests(spark: SparkSession, path: str, pattern: str = "*", piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(path, size_bytes, sha256) of the files below a folder, or of one file.

    Spark lists the files; tasks read them, a file each at a time. A store that Arrow cannot open is read by Spark's own reader of
    binary files, which takes files of up to 2 GB. Spark lists no file without a byte, so such a file has no row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    try:
        pafs.FileSystem.from_uri(arrow_uri(path))
    except (pa.ArrowInvalid, OSError):
        return files.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                fs, place = pafs.FileSystem.from_uri(arrow_uri(name))
                whole, size = hashlib.sha256(), 0
                with fs.open_input_stream(place) as stream:
                    while piece := stream.read(piece_bytes):
                        whole.update(piece)
                        size += len(piece)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size]), pa.array([whole.hexdigest()])], ["path", "size_bytes", "sha256"])

    # Paths only are listed and dealt; the files are not split, so large ones should not share a task.
    listed = files.select("path").repartition(shuffle_width(spark), "path")
    return listed.mapInArrow(read, "path string, size_bytes bigint, sha256 string")
