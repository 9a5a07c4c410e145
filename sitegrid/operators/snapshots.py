"""What changed between full snapshots: compact hashes in buckets, compared as sorted arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitegrid.operators.skew import skew_join

#: Rows (16 bytes of key and hash each) that a bucket holds on average.
BUCKET_ROWS = 200_000
KINDS = ("added", "removed", "changed")


def latest_rows(df: DataFrame, key: str, snapshot: str, loaded: str, tracked: list[str]) -> DataFrame:
    """One row per key and snapshot: the one loaded last (null is the oldest; further ties go to the largest values).

    Rows without a key or a snapshot belong to no entity and are left out.
    """
    best = F.max(F.struct(F.col(loaded).alias("at"), *tracked)).alias("__best")
    return df.where(F.col(key).isNotNull() & F.col(snapshot).isNotNull()).groupBy(key, snapshot).agg(best).select(key, snapshot, *[F.col(f"__best.{c}").alias(c) for c in tracked])


def _compared(pairs: list[tuple[int, int]], key_type: pa.DataType):
    """Set differences of the snapshots of one bucket by ``searchsorted`` on sorted key arrays."""

    def bucket(rows: pa.Table) -> pa.Table:
        index = rows.column("__s").to_numpy()
        keys, hashes = rows.column("__key").to_numpy(), rows.column("__hash").to_numpy()
        order = np.lexsort((keys, index))
        index, keys, hashes = index[order], keys[order], hashes[order]
        cut = lambda s: slice(*np.searchsorted(index, [s, s + 1]))
        out_key, out_pair, out_kind = [], [], []
        for p, (a, b) in enumerate(pairs):
            ka, ha, kb, hb = keys[cut(a)], hashes[cut(a)], keys[cut(b)], hashes[cut(b)]
            at = np.searchsorted(ka, kb)
            inside = at < len(ka)
            found = np.zeros(len(kb), bool)
            found[inside] = ka[at[inside]] == kb[inside]
            kept = np.zeros(len(ka), bool)
            kept[at[found]] = True
            unlike = np.zeros(len(kb), bool)
            unlike[found] = ha[at[found]] != hb[found]
            for kind, some in enumerate((kb[~found], ka[~kept], kb[unlike])):
                out_key.append(some)
                out_pair.append(np.full(len(some), p, np.int32))
                out_kind.append(np.full(len(some), kind, np.int32))
        join = lambda parts, dtype: np.concatenate(parts) if parts else np.empty(0, dtype)
        return pa.table({"__key": join(out_key, np.int64), "__pair": join(out_pair, np.int32), "__kind": join(out_kind, np.int32)})

    return bucket


def _compact(df: DataFrame, tracked: list[str]) -> tuple[DataFrame, list[str]]:
    """What stands for the tracked columns in the first shuffle: a single number or date is as small as its hash."""
    if len(tracked) == 1 and isinstance(df.schema[tracked[0]].dataType, (T.NumericType, T.DateType, T.TimestampType, T.BooleanType)):
        return df, tracked
    return df.withColumn("__row_hash", F.xxhash64(*[x for c in tracked for x in (F.col(c).isNull(), F.col(c))])), ["__row_hash"]


def snapshot_changes(df: DataFrame, key: str, snapshot: str, loaded: str, tracked: list[str], snapshots: list, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Keys added, removed or changed between neighbours of ``snapshots``: ``key, t0, t1, change``.

    Only an integer key, the snapshot, the time of loading and a 64-bit hash of the tracked columns (or their only value,
    if it is no larger) are shuffled, to take the latest row of each key (map-side combined; further ties go to the largest
    hash or value); then key, number and hash go into buckets by the key's hash. Keys are unique there, so no bucket is
    hot. ``key`` must be an integer column. Null is a value of its own in the tracked columns.
    """
    days = [str(d) for d in snapshots]
    pairs = [(i, i + 1) for i in range(len(days) - 1)]
    rows = df.where(F.col(snapshot).cast("string").isin(days))
    buckets = max(rows.select(key).count() // bucket_rows, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) if df.sparkSession.conf.get("spark.sql.shuffle.partitions").isdigit() else 1, 1)
    number = F.array_position(F.array(*[F.lit(d) for d in days]), F.col(snapshot).cast("string")) - 1
    rows, slim = _compact(rows, tracked)
    hashed = F.xxhash64(*[x for c in slim for x in (F.col(c).isNull(), F.col(c))])
    compact = latest_rows(rows, key, snapshot, loaded, slim).select(F.col(key).cast("long").alias("__key"), number.cast("int").alias("__s"), hashed.alias("__hash"))
    compact = compact.withColumn("__bucket", F.pmod(F.xxhash64("__key"), F.lit(buckets)))
    changes = compact.groupBy("__bucket").applyInArrow(_compared(pairs, pa.int64()), "__key long, __pair int, __kind int")
    at = lambda shift: F.element_at(F.array(*[F.lit(d) for d in days]), F.col("__pair") + 1 + shift)
    return changes.select(F.col("__key").alias(key), at(0).alias("t0"), at(1).alias("t1"), F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("__kind") + 1).alias("change"))


def with_values(changes: DataFrame, df: DataFrame, key: str, snapshot: str, loaded: str, tracked: list[str]) -> DataFrame:
    """The changes with ``<column>_t0`` and ``<column>_t1``, fetched only for keys that differ."""
    rows = skew_join(df.select(key, snapshot, loaded, *tracked), changes.select(key).distinct(), [key], "left_semi")
    rows, slim = _compact(rows, tracked)
    latest = latest_rows(rows, key, snapshot, loaded, [*slim, *[c for c in tracked if c not in slim]])
    out = changes
    for side in ("t0", "t1"):
        values = latest.select(key, F.col(snapshot).cast("string").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in tracked])
        out = out.join(values, [key, side], "left")
    return out.select(key, "t0", "t1", "change", *[f"{c}_{side}" for c in tracked for side in ("t0", "t1")])
