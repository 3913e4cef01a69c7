"""Incremental processing of arriving files."""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from threading import Event

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..functions.expressions import path_name
from ..sources.files import IMAGES
from ..sources.pixels import explode_pixels, read_images


#: How many tasks list the files of a batch; Spark's own number is one for each file.
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
#: After how many batches the source writes its list of all files so far anew; Spark's ten make that most of a long stream.
COMPACTING, BATCHES_APART = "spark.sql.streaming.fileSource.log.compactInterval", 500
#: Batches of images that are decoded at the same time, each by jobs of its own.
AT_ONCE = 4
#: Files and bytes of them that a task of a batch decodes; Spark would deal few small files over all cores.
TASK_FILES, TASK_BYTES = 32, 1 << 20


def _place(spark: SparkSession, path: str):
    """A path as Hadoop has it, and its file system."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def _put(spark: SparkSession, path: str, body: bytes) -> None:
    """A small file of the driver's, whole or not there at all; until then readers pass over it by its name."""
    target, store = _place(spark, path)
    part, _ = _place(spark, f"{target.getParent()}/_{target.getName()}")
    out = store.create(part, True)
    out.write(body)
    out.close()
    store.delete(target, False)
    if not store.rename(part, target):
        raise OSError(f"{path} can't be written")


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each name once for each task."""
    seen = set()
    for batch in batches:
        new = [n for n in batch.column(0).unique().to_pylist() if n not in seen]
        seen.update(new)
        yield pa.RecordBatch.from_arrays([pa.array(new, pa.string())], names=["name"])


def ingest(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, process: Callable[[DataFrame], DataFrame] | None = None, key: str | None = None, glob: str | None = None, format: str = "parquet") -> StreamingQuery:
    """Process what arrived since the last call with the same checkpoint, then stop.

    ``process`` is the batch pipeline. Each batch has its own folder in the sink (column ``batch``) and overwrites it, so
    a retried batch repeats no rows. With ``key``, rows whose key another batch of the sink holds are left out.
    """
    reader = spark.readStream.schema(schema).format(format)
    stream = (reader.option("pathGlobFilter", glob) if glob else reader).load(source)

    def write(batch: DataFrame, number: int) -> None:
        made = process(batch) if process else batch
        session = batch.sparkSession
        hadoop = session._jvm.org.apache.hadoop.fs.Path(sink)
        if key and hadoop.getFileSystem(session._jsc.hadoopConfiguration()).exists(hadoop):
            held = session.read.schema(made.schema).parquet(sink).where(F.col("batch") != number).select(key)
            made = made.dropDuplicates([key]).join(held, key, "left_anti").select(made.columns)
        made.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


class Progress(StreamingQueryListener):
    """What a stream did, batch by batch, as Spark reports it: rows of (batch, n_files)."""

    def __init__(self):
        self.rows, self.ended = [], Event()

    def onQueryStarted(self, event):
        self.ended.clear()

    def onQueryProgress(self, event):
        if event.progress.numInputRows:
            self.rows.append((event.progress.batchId, event.progress.numInputRows))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.ended.set()


def ingest_images(spark: SparkSession, source: str, sink: str, dead_letters: str, checkpoint: str, process: Callable[[DataFrame], DataFrame] | None = None, max_files: int = 1000) -> list[tuple[int, int]]:
    """Image files that arrived since the last call with the same checkpoint; gives back the progress by batch.

    A batch takes at most ``max_files`` files, whose paths and lengths alone pass the driver. Pixels of files that decode, through
    ``process`` where given (it keeps ``name``), go to the batch's folder of the sink; the names of the others go to its folder of the dead letters.
    Both are overwritten when a batch is retried, so nothing is lost and nothing doubled. A batch lists its files once more,
    in as many tasks as there are cores and not one for each file, and reads no file twice.

    The stream goes on while up to AT_ONCE batches are decoded, so these may end in any order; all have ended when the call
    returns. What arrived in a batch is noted beside the checkpoint before the stream counts it as done, until its dead
    letters stand; a call takes up first what an earlier one noted and did not end.
    """
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("maxFilesPerTrigger", max_files).load(source)
    stream = stream.select("path", "length", path_name(F.col("path")).alias("name")).where(F.col("name").rlike(IMAGES))
    notes, running = f"{checkpoint}/arrived", []

    def decode(session: SparkSession, number: int, arrived: list[dict]) -> None:
        tasks = max(1, -(-len(arrived) // TASK_FILES), sum(r["length"] for r in arrived) // TASK_BYTES)
        pixels = explode_pixels(read_images(session, [r["path"] for r in arrived]).coalesce(tasks), ["name"])
        made = process(pixels) if process else pixels
        made.write.mode("overwrite").parquet(f"{sink}/batch={number}")
        held = {r["name"] for r in session.read.schema(made.schema).parquet(f"{sink}/batch={number}").select("name").mapInArrow(_names, "name string").collect()}
        lost = [r for r in arrived if r["name"] not in held]
        table = pa.table({"name": pa.array([r["name"] for r in lost], pa.string()), "length": pa.array([r["length"] for r in lost], pa.int64())})
        pq.write_table(table, body := io.BytesIO())
        folder, store = _place(session, f"{dead_letters}/batch={number}")
        store.delete(folder, True)
        _put(session, f"{dead_letters}/batch={number}/part-0.parquet", body.getvalue())
        note, store = _place(session, f"{notes}/{number}.json")
        store.delete(note, False)

    def write(batch: DataFrame, number: int) -> None:
        arrived = [r.asDict() | {"number": number} for r in batch.collect()]
        if not arrived:
            return
        _put(batch.sparkSession, f"{notes}/{number}.json", "\n".join(map(json.dumps, arrived)).encode())
        while len(running) >= AT_ONCE:
            running.pop(0).result()
        running.append(pool.submit(decode, batch.sparkSession, number, arrived))

    seen, own = Progress(), {LISTING: str(spark.sparkContext.defaultParallelism), COMPACTING: str(BATCHES_APART)}
    before = {k: spark.conf.get(k) for k in own}
    spark.streams.addListener(seen)
    try:
        for k, v in own.items():
            spark.conf.set(k, v)  # the stream's source lists with this session
        folder, store = _place(spark, notes)
        if store.exists(folder):
            left = {}
            for r in spark.read.schema("path string, length bigint, name string, number int").json(notes).collect():
                left.setdefault(r["number"], []).append(r.asDict())
            for number, arrived in sorted(left.items()):
                decode(spark, number, arrived)
        with ThreadPoolExecutor(AT_ONCE) as pool:
            query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
            query.awaitTermination()
            for batch in running:
                batch.result()
        seen.ended.wait(30)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.streams.removeListener(seen)
    return seen.rows
