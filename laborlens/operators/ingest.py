"""Write semantics as DataFrame operators: first wins, last wins, updates, dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from laborlens import vocab
from laborlens.schema import ARRIVING, POSTING_DEFAULTS, conform
from laborlens.session import cut_lineage

KEY_BYTES = 8 << 20             # repeated keys up to this size are sent to every task


def accept(arriving: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that can be stored, and rows without a title.

    Defaults apply only where a column is absent from the feed; a NULL company is 'Unknown'.
    Columns of the arrival itself (its time, its file) stay behind the posting's, to order by.
    """
    company = (F.coalesce("company", F.lit(vocab.UNKNOWN_COMPANY))
               if "company" in arriving.columns else F.lit(vocab.UNKNOWN_COMPANY))
    arrival = [c for c in arriving.columns if c not in ARRIVING.fieldNames()]
    rows = conform(arriving.withColumn("company", company), ARRIVING, POSTING_DEFAULTS, arrival)
    return rows.where("title IS NOT NULL"), rows.where("title IS NULL")


def _one_per_key(df: DataFrame, keys, order) -> DataFrame:
    """The first row of each key; the limit also runs before the shuffle, so a hot key
    sends one row per task."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def first_wins(df: DataFrame, order, key: str = "source_id") -> DataFrame:
    """The first arrival of each key; rows without key never collide, as each has its own."""
    own = F.when(F.col(key).isNull(), F.monotonically_increasing_id())
    return _one_per_key(df.withColumn("_own", own), [key, "_own"], order).drop("_own")


def first_arrivals(df: DataFrame, order, key: str = "source_id") -> DataFrame:
    """As ``first_wins``, where most keys come once: only rows whose key comes again are shuffled whole.

    Keys are counted first. Those that come again are sent to every task up to KEY_BYTES; where they are more, all rows meet.
    """
    repeated = cut_lineage(df.select(key).where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key),
                           "repeated-keys")
    size = repeated.agg(F.sum(F.octet_length(F.col(key).cast("string")))).first()[0]
    if size is None:
        return df
    if size > KEY_BYTES:
        return first_wins(df, order, key)
    once = df.join(F.broadcast(repeated), key, "left_anti").select(df.columns)
    return once.unionByName(_one_per_key(df.join(F.broadcast(repeated), key, "left_semi").select(df.columns), [key], order))


def last_wins(df: DataFrame, keys, order) -> DataFrame:
    """The last row of each key, by a descending order."""
    return _one_per_key(df, keys, order)


def not_stored(batch: DataFrame, stored: DataFrame, key: str = "source_id") -> DataFrame:
    """Rows of a deduplicated batch whose key the store does not hold, or that have no key.

    The stored keys are first cut down to those of the batch, so the store is only scanned,
    not shuffled, while the batch is small enough to be broadcast.
    """
    hits = stored.select(key).join(batch.select(key), key, "left_semi")
    return batch.join(hits, key, "left_anti")


def unseen(arriving: DataFrame, stored: DataFrame, key: str = "source_id") -> DataFrame:
    """Arriving rows, repeats included, whose key the store does not hold, or that have no key.

    Only keys are compared; whole rows then meet the new keys, or none at all where no key is new.
    """
    keys = arriving.select(key).where(F.col(key).isNotNull()).distinct()
    new = cut_lineage(keys.join(stored.select(key), key, "left_anti"), "new-keys")
    bare = arriving.where(F.col(key).isNull())
    return bare if new.isEmpty() else bare.unionByName(arriving.join(new, key, "left_semi").select(arriving.columns))


def company_id(name: Column) -> Column:
    """Stable key of a dimension row: no sequence and no lookup join needed."""
    return F.xxhash64(name)


def new_dimension_rows(rows: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Distinct new values of a unique column, one row each."""
    return not_stored(rows.where(F.col(key).isNotNull()).dropDuplicates([key]), stored, key)


def get_or_create(rows: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """The dimension after the insert: old rows untouched, new ones added."""
    return stored.unionByName(new_dimension_rows(rows, stored, key), allowMissingColumns=True)


def replace_rows(stored: DataFrame, changed: DataFrame, keys) -> DataFrame:
    """Insert or replace by key; keys absent from the change stay. ``changed`` has one row per
    key. A small change is broadcast, so the stored rows need no shuffle."""
    kept = stored.join(changed.select(*keys), list(keys), "left_anti")
    return kept.unionByName(changed, allowMissingColumns=True)


def update_columns(stored: DataFrame, updates: DataFrame, key: str, columns) -> DataFrame:
    """Point updates by key: the new value where there is one; ``updates`` has one row per key."""
    renamed = updates.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = stored.join(renamed, key, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c)
                           for c in stored.columns])


def reset_columns(stored: DataFrame, columns) -> DataFrame:
    """The columns NULL in every row."""
    return stored.withColumns({c: F.lit(None).cast(stored.schema[c].dataType) for c in columns})


def ingest_counts(arriving: DataFrame, inserted: DataFrame, rejected: DataFrame) -> DataFrame:
    """(arrived, inserted, rejected, duplicate) of one batch."""
    def tally(df, name):
        return df.agg(F.count(F.lit(1))).select(F.lit(name).alias("kind"), F.col("count(1)").alias("n"))
    parts = (tally(arriving, "arrived").unionByName(tally(inserted, "inserted"))
             .unionByName(tally(rejected, "rejected")))
    one = parts.groupBy().pivot("kind", ["arrived", "inserted", "rejected"]).agg(F.sum("n"))
    return one.withColumn("duplicate", F.col("arrived") - F.col("inserted") - F.col("rejected"))
