"""Vector stores as a Spark data source: tasks send batches, the driver prepares the store, and publishes or discards a load.

A store is reached through a client that workers make from its import path and the load's options.  A store without
transactions takes rows when they are sent (its upserts are idempotent by id) and ignores publish and discard; one with
transactions, like the file-backed store here, shows a load as a whole or not at all.
"""

from __future__ import annotations

import importlib
import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .providers import PermanentError, with_retries

#: Columns that say which rows are sent together; stores do not get them.
DOC, BATCH = "__doc", "__batch"
RESULT = "sent long, inserted long, failed long, error string"


class BatchWriter(Protocol):
    def send(self, rows: pa.Table) -> int:
        """Upsert rows by id; how many the store took."""

    def close(self) -> str:
        """What the driver needs to publish the rows of this task."""


class StoreClient(Protocol):
    def prepare(self, dimension: int | None) -> None: ...

    def writer(self, job: str, task: str) -> BatchWriter: ...

    def publish(self, job: str, tokens: list[str]) -> None: ...

    def discard(self, job: str) -> None: ...

    def report(self, job: str, lines: list[dict]) -> None: ...


class FileStore:
    """Collections in a shared folder: ``<path>/<collection>/tenant=<tenant>/load=<n>/*.parquet``.

    Options: path (a folder or address that all workers reach), collection, tenant ('default'), create: 'nothing' (the
    collection must be there), 'tenant' (its tenant may be missing) or 'collection' (all is made), vector: the vectors'
    column.  Tasks write below ``_pending``; publishing is one rename, so readers never see part of a load.
    """

    def __init__(self, options: dict[str, str]):
        self.fs, root = pafs.FileSystem.from_uri(options["path"])
        self.base = f"{root.rstrip('/')}/{options['collection']}"
        self.home = f"{self.base}/tenant={options.get('tenant') or 'default'}"
        self.create, self.vector = options.get("create", "nothing"), options.get("vector", "values")

    def _there(self, path: str) -> bool:
        return self.fs.get_file_info(path).type != pafs.FileType.NotFound

    def _meta(self) -> dict:
        with self.fs.open_input_stream(f"{self.base}/_store.json") as f:
            return json.loads(f.read())

    def prepare(self, dimension: int | None) -> None:
        if not self._there(f"{self.base}/_store.json"):
            if self.create != "collection":
                raise LookupError(f"no collection at {self.base}")
            self.fs.create_dir(self.base, recursive=True)
            with self.fs.open_output_stream(f"{self.base}/_store.json") as f:
                f.write(json.dumps({"dimension": dimension}).encode())
        if not self._there(self.home):
            if self.create == "nothing" and not self.home.endswith("tenant=default"):
                raise LookupError(f"no tenant at {self.home}")
            self.fs.create_dir(self.home, recursive=True)

    def _pending(self, job: str) -> str:
        return f"{self.base}/_pending/{job}"

    def writer(self, job: str, task: str) -> BatchWriter:
        return _FileBatches(self, f"{self._pending(job)}/part-{task}.parquet", self._meta()["dimension"])

    def publish(self, job: str, tokens: list[str]) -> None:
        pending = self._pending(job)
        if not self._there(pending):
            return
        for f in self.fs.get_file_info(pafs.FileSelector(pending)):
            if f.base_name not in tokens:  # of an attempt that failed
                self.fs.delete_file(f.path)
        loads = [int(f.base_name.split("=")[1]) for f in self.fs.get_file_info(pafs.FileSelector(self.home)) if "=" in f.base_name]
        self.fs.move(pending, f"{self.home}/load={max(loads, default=0) + 1:06d}")

    def discard(self, job: str) -> None:
        if self._there(self._pending(job)):
            self.fs.delete_dir(self._pending(job))

    def report(self, job: str, lines: list[dict]) -> None:
        self.fs.create_dir(f"{self.base}/_reports", recursive=True)
        with self.fs.open_output_stream(f"{self.base}/_reports/{job}.json") as f:
            f.write("".join(json.dumps(x) + "\n" for x in lines).encode())


class _FileBatches:
    """One file of a task, made with its first rows."""

    def __init__(self, store: FileStore, path: str, dimension: int | None):
        self.store, self.path, self.dimension, self.out = store, path, dimension, None

    def send(self, rows: pa.Table) -> int:
        if self.dimension is not None and self.store.vector in rows.column_names:
            sizes = pc.list_value_length(rows.column(self.store.vector))
            if pc.any(pc.not_equal(sizes, self.dimension)).as_py():
                raise PermanentError(f"vectors of this collection have {self.dimension} numbers")
        if self.out is None:
            self.store.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
            self.out = pq.ParquetWriter(self.path, rows.schema, filesystem=self.store.fs, compression="zstd")
        self.out.write_table(rows)
        return len(rows)

    def close(self) -> str:
        if self.out is None:
            return ""
        self.out.close()
        return self.path.rsplit("/", 1)[1]


def client_of(options: dict[str, str]) -> StoreClient:
    """The client that the option 'client' names as module:class; the file-backed store where there is none."""
    module, _, name = options.get("client", f"{__name__}:FileStore").partition(":")
    return getattr(importlib.import_module(module), name)(options)


def cut_batches(rows: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Rows in order, cut where the document or its batch changes, and after ``size`` rows."""
    held: list[pa.RecordBatch] = []
    n, last = 0, None
    for part in rows:
        if not len(part):
            continue
        turn = np.zeros(len(part), bool)
        for c in (DOC, BATCH):
            column = pc.fill_null(part.column(c).cast(pa.string()), "")
            turn[1:] |= np.asarray(pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)))
        key = tuple(part.column(c)[0].as_py() for c in (DOC, BATCH))
        turn[0] = last is not None and key != last
        last = tuple(part.column(c)[-1].as_py() for c in (DOC, BATCH))
        edges = [*np.flatnonzero(turn).tolist(), len(part)]
        at = 0
        for i, edge in enumerate(edges):
            while at < edge:
                step = min(size - n, edge - at)
                held.append(part.slice(at, step))
                n, at = n + step, at + step
                if n == size:
                    yield pa.Table.from_batches(held)
                    held, n = [], 0
            if i < len(edges) - 1 and held:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


@dataclass
class Sent(WriterCommitMessage):
    token: str
    sent: int
    inserted: int
    failed: int
    error: str | None


class StoreWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.options, self.job = options, options.get("job") or uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Sent:
        task = TaskContext.get()
        out = client_of(self.options).writer(self.job, f"{task.partitionId():06d}-{task.taskAttemptId()}")
        pause, said = float(self.options.get("pause", 2)), Sent("", 0, 0, 0, None)
        for rows in cut_batches(iterator, int(self.options.get("batch", 100))):
            own = rows.drop_columns([DOC, BATCH])
            said.sent += len(own)
            try:
                said.inserted += with_retries(lambda: out.send(own), int(self.options.get("attempts", 2)), lambda n: pause, time.sleep)
            except Exception as e:  # a batch that the store refuses is counted; the others go on
                said.failed, said.error = said.failed + 1, said.error or str(e) or type(e).__name__
        said.token = out.close()
        return said

    def commit(self, messages: list[Sent | None]) -> None:
        done, client = [m for m in messages if m is not None], client_of(self.options)
        client.publish(self.job, [m.token for m in done if m.token])
        client.report(self.job, [{"sent": m.sent, "inserted": m.inserted, "failed": m.failed, "error": m.error} for m in done])

    def abort(self, messages: list[Sent | None]) -> None:
        client_of(self.options).discard(self.job)


class VectorStoreSource(DataSource):
    """``df.write.format("vector_store").options(...)``: df holds the columns that say what is sent together (DOC, BATCH)."""

    @classmethod
    def name(cls) -> str:
        return "vector_store"

    def writer(self, schema, overwrite: bool) -> StoreWriter:
        if overwrite:
            raise ValueError("a store is added to, by id; use mode('append')")
        return StoreWriter(dict(self.options))


def load(payload: DataFrame, options: dict[str, str], doc: str | None = None, index: str | None = None) -> DataFrame:
    """Upsert a payload by id; one row a task: sent, inserted, failed (batches), error (the first).

    doc, index: the document and the place in it (from 1) of a row; rows are then sent by document, in batches of
    ``batch`` (100).  A document's batches may go to different tasks, so a long one holds up no other.  A batch that fails
    is tried again once after ``pause`` (2) seconds and then counted; if a task fails for good, nothing of the load stays
    in a store with transactions.
    """
    spark = payload.sparkSession
    spark.dataSource.register(VectorStoreSource)
    options = {"vector": "values", **options, "job": uuid.uuid4().hex}
    size = int(options.get("batch", 100))
    first = payload.where(F.col(options["vector"]).isNotNull()).select(F.size(options["vector"])).first()
    client_of(options).prepare(first[0] if first else None)
    if doc:
        place = F.col(index) if index else F.lit(1)
        rows = payload.withColumns({DOC: F.coalesce(F.col(doc).cast("string"), F.lit("unknown_document")), BATCH: F.floor((place - 1) / size)})
        rows = rows.repartition(DOC, BATCH).sortWithinPartitions(DOC, BATCH, "id")
    else:
        rows = payload.withColumns({DOC: F.lit(""), BATCH: F.lit(0)})
    rows.write.format("vector_store").options(**options).mode("append").save()
    return spark.read.schema(RESULT).json(f"{options['path'].rstrip('/')}/{options['collection']}/_reports/{options['job']}.json")


def stored(spark: SparkSession, path: str, collection: str, tenant: str = "default", key: str = "id") -> DataFrame:
    """The rows of a file-backed collection: of each id that of its newest load (of several there, the one with the greatest
    hash)."""
    rows = spark.read.parquet(f"{path.rstrip('/')}/{collection}/tenant={tenant}")
    own = [F.col(f"`{c}`") for c in rows.columns if c != "load"]
    return rows.groupBy(key).agg(F.max_by(F.struct(*own), F.struct("load", F.xxhash64(*own))).alias("row")).select("row.*")
