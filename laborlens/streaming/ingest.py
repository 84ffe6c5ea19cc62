"""Structured Streaming forms of ingest, index upkeep and summary backfill."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from laborlens.functions import replies
from laborlens.functions.text import truncate
from laborlens.operators import filters, ingest
from laborlens.operators.store import Store
from laborlens.plans import refresh
from laborlens.schema import SUMMARY, conform
from laborlens.session import slices


def landed_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                  files_per_trigger: int = 1000) -> DataFrame:
    """Landed files as a stream, with the arrival time and the file they came in."""
    return (spark.readStream.schema(schema).format(fmt)
            .option("maxFilesPerTrigger", files_per_trigger).load(path)
            .withColumn("arrived_at", F.col("_metadata.file_modification_time"))
            .withColumn("file", F.col("_metadata.file_path")))


def drop_repeats(stream: DataFrame, within: str = "2 days", key: str = "source_id") -> DataFrame:
    """Optional pre-filter: forget repeats of a key that arrive close together.

    The watermark is on arrival time: one on event time would drop late postings, which are
    to be kept. State is forgotten after the delay, so the store's check stays decisive.
    """
    return stream.withWatermark("arrived_at", within).dropDuplicatesWithinWatermark([key])


def ingest_stream(stream: DataFrame, store: Store, checkpoint: str, order=("arrived_at", "file"),
                  normalise=lambda df: df, after=None, name: str = "ingest",
                  interval: str | None = None) -> StreamingQuery:
    """First-wins ingest of every micro-batch into the store.

    A batch that was committed before a failure is recognised by its note and skipped. With
    ``interval`` the query keeps running, otherwise it ends when all landed files are read.
    """
    def one(batch, batch_id):
        note = f"{name}:{batch_id}"
        if not store.committed(note):
            refresh.store_batch(store, normalise(batch), [F.col(c) for c in order], note=note)
        if after is not None:
            after(store)

    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return (stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
            .queryName(name).trigger(**trigger).start())


def stored_first(stream: DataFrame, path: str, checkpoint: str, order, key: str) -> StreamingQuery:
    """Append rows with unseen keys to one Parquet folder; first arrival wins.

    Each micro-batch writes its own ``batch`` partition and replaces it when run again.
    """
    def one(batch, batch_id):
        spark = batch.sparkSession
        rows = ingest.first_wins(batch, order, key)
        if batch_id > 0:
            stored = spark.read.parquet(path).where(F.col("batch") < batch_id)
            rows = ingest.not_stored(rows, stored, key)
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def summarise_rows(rows: DataFrame, summarise, chars: int | None = None) -> DataFrame:
    """(posting_id, summary_en, summary_ar) from a plugged-in text model.

    ``summarise(series of text) -> series of replies`` is called per slice of a few MB; ``chars`` limits
    the text for a model that takes no more.
    """
    def run(batches):
        for batch in slices(batches, "text"):
            raw = summarise(batch.column("text").to_pandas())
            yield pa.RecordBatch.from_arrays([batch.column("posting_id").cast(pa.int64()),
                                              pa.Array.from_pandas(raw, type=pa.string())], ["posting_id", "raw"])
    sent = rows.select("posting_id", truncate(F.trim("description"), chars).alias("text"))
    answered = sent.mapInArrow(run, "posting_id long, raw string")
    raw, parsed = F.col("raw"), replies.parsed(F.col("raw"))
    return answered.select("posting_id",
                           replies.text_field(raw, parsed, "summary_en").alias("summary_en"),
                           replies.text_field(raw, parsed, "summary_ar").alias("summary_ar"))


def backfill_summaries(store: Store, summarise, as_of=None, limit: int | None = None,
                       chars: int | None = None) -> None:
    """Summarise some fresh postings; a reply that lacks either summary leaves its row open.

    Only the new summaries are written; readers take the last one of each posting.
    """
    todo = filters.backfill_candidates(refresh.with_summaries(store), as_of, limit)
    done = (summarise_rows(todo, summarise, chars).where(filters.present("summary_en", "summary_ar"))
            .withColumn("written_at", F.current_timestamp().cast("timestamp_ntz")))
    store.commit(append={"summaries": conform(done, SUMMARY)}, note="summaries")


def reset_summaries(store: Store) -> None:
    """Forget all summaries, so that they are written anew."""
    store.commit(replace={"summaries": store.spark.createDataFrame([], SUMMARY)},
                 note="summaries reset")
