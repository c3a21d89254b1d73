"""Arrow IPC files and streams."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import from_arrow_schema


def _open(data: bytes) -> pa.RecordBatchReader | pa.RecordBatchFileReader:
    return pa.ipc.open_file(data) if data[:6] == b"ARROW1" else pa.ipc.open_stream(data)


def _batches(data: bytes) -> Iterator[pa.RecordBatch]:
    reader = _open(data)
    if isinstance(reader, pa.RecordBatchFileReader):
        for i in range(reader.num_record_batches):
            yield reader.get_batch(i)
    else:
        yield from reader


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of one IPC file or of all in a folder; each file is read in its own task.

    A task holds one file at a time, which may have up to 2 GB; larger tables take more
    files. Only the first file's schema comes to the driver.
    """
    files = spark.read.format("binaryFile").load(path)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"schema": [_open(content.as_py()).schema.serialize().to_pybytes() for content in batch.column(0)]})

    first = files.select("content").limit(1).mapInArrow(look, "schema binary").collect()
    if not first:
        raise ValueError(f"there are no files in {path}")
    schema = from_arrow_schema(pa.ipc.read_schema(pa.BufferReader(bytes(first[0]["schema"]))), prefer_timestamp_ntz=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield from _batches(content.as_py())

    return files.select("content").mapInArrow(run, schema)


def write(df: DataFrame, folder: str, compression: str | None = None) -> DataFrame:
    """Writes an IPC file for each partition, from its task; returns (file, rows) when run."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        name, rows, writer, out = f"part-{uuid.uuid4().hex}.arrow", 0, None, None
        for batch in batches:
            if writer is None:
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
                writer = pa.ipc.new_file(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression=compression))
            writer.write_batch(batch)
            rows += batch.num_rows
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "rows": [rows]}, schema=pa.schema([("file", pa.string()), ("rows", pa.int64())]))

    return df.select(*names).mapInArrow(run, "file string, rows bigint")
