"""A transactional table of rows: ``format("alert_log")``, to write as a batch or as a stream.

Each task writes one Parquet file under a name of its own, hidden until it is whole, and sends that name.  The driver
commits by one manifest, which names the files of a batch and appears in one step; rows are there if a
manifest names their file.  A task that is killed leaves a file that no manifest names; the next commit or abort
removes such files.  A batch whose manifest is there already (it ran again after a failure) adds nothing.

Options: ``path``, a folder of any file system that pyarrow knows by its URL, with one writer at a
time.  A batch is overwritten or appended as the write says; a stream's batches go by their numbers.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..sources.poll_stream import place_of


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    n_rows: int


class _Files:
    """What a batch's and a stream's writers share."""

    def __init__(self, options: dict[str, str], overwrite: bool = False) -> None:
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite

    def put(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, folder = place_of(self.path)
        name, n, out = f"{uuid.uuid4()}.parquet", 0, None
        system.create_dir(f"{folder}/data")
        for batch in batches:
            if out is None:
                stream = system.open_output_stream(f"{folder}/data/.{name}")
                out = pq.ParquetWriter(stream, batch.schema, compression="zstd")
            out.write_batch(batch)
            n += batch.num_rows
        if out is None:
            return Written(None, 0)
        out.close()
        stream.close()
        system.move(f"{folder}/data/.{name}", f"{folder}/data/{name}")
        return Written(name, n)

    def close(self, messages: list[Written | None], batch: str | None) -> None:
        """Commit what was sent as ``batch``, or nothing, and remove the files that no manifest names."""
        system, folder = place_of(self.path)
        for sub in ("data", "batches"):
            system.create_dir(f"{folder}/{sub}")
        seen = {f.base_name.removesuffix(".json"): f.path for f in system.get_file_info(fs.FileSelector(f"{folder}/batches")) if not f.base_name.startswith(".")}
        if batch is not None and batch not in seen:
            files = [{"file": m.file, "n_rows": m.n_rows} for m in messages if m and m.file]
            with system.open_output_stream(f"{folder}/batches/.{batch}") as f:
                f.write("".join(json.dumps({"batch": batch, **x}) + "\n" for x in files).encode("utf-8"))
            system.move(f"{folder}/batches/.{batch}", f"{folder}/batches/{batch}.json")
            if self.overwrite:
                for path in seen.values():
                    system.delete_file(path)
                seen = {}
            seen[batch] = f"{folder}/batches/{batch}.json"
        named = set()
        for path in seen.values():
            with system.open_input_stream(path) as f:
                named |= {json.loads(line)["file"] for line in f.read().splitlines()}
        for f in system.get_file_info(fs.FileSelector(f"{folder}/data")):
            if f.base_name not in named:
                system.delete_file(f.path)


class BatchWriter(_Files, DataSourceArrowWriter):
    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self.put(iterator)

    def commit(self, messages: list[Written | None]) -> None:
        self.close(messages, f"b-{uuid.uuid4()}")

    def abort(self, messages: list[Written | None]) -> None:
        self.close(messages, None)


class StreamWriter(_Files, DataSourceStreamArrowWriter):
    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self.put(iterator)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self.close(messages, f"s-{batchId:012d}")

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self.close(messages, None)


class AlertLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "alert_log"

    def writer(self, schema: StructType, overwrite: bool) -> BatchWriter:
        return BatchWriter(self.options, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamWriter:
        return StreamWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(AlertLog)


def committed(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of all commits, and the ``batch`` of each."""
    path = path.rstrip("/")
    system, folder = place_of(path)
    for sub in ("data", "batches"):
        system.create_dir(f"{folder}/{sub}")
    named = spark.read.schema("batch string, file string").json(f"{path}/batches")
    rows = spark.read.schema(schema).parquet(f"{path}/data").select("*", F.col("_metadata.file_name").alias("_file"))
    return rows.join(named, F.col("_file") == F.col("file")).drop("_file", "file")
