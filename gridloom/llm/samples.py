"""Bounded samples, drawn from all data alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % folds


def _hash(key: str, seed: int) -> Column:
    return F.xxhash64(F.col(f"`{key}`"), F.lit(seed))


def _below(each: int, n: int | Column) -> Column:
    """The hash that about twice ``each`` of ``n`` keys are below."""
    share = F.least(F.lit(1.0), F.lit(2.0 * each + 64) / F.greatest(n if isinstance(n, Column) else F.lit(n), F.lit(1)))
    return F.least(F.lit(-(2.0**63)) + share * F.lit(2.0**64), F.lit(2.0**63 - 1024)).cast("long")


def draw(rows: DataFrame, n: int, each: int, seed: int, key: str, by: str | None = None) -> DataFrame:
    """At most ``each`` rows (of every value of ``by``), one for each key, in order of a hash of the key.

    ``n``: about how many rows there are; with ``by``, the name of a column that has it for each value.
    A first cut by the hash leaves about twice as many keys as are wanted, of which the first stay,
    so no task holds more than a few times the sample. A key that repeats gives the row that is least
    by a hash of its content. The choice follows from the content alone, not from files or tasks.
    """
    size = F.col(n) if isinstance(n, str) else n
    few = rows.where(_hash(key, seed) <= _below(each, size))
    rest = [c for c in rows.columns if c != key]
    content = F.struct(*[F.col(f"`{c}`") for c in rest])
    one = few.groupBy(f"`{key}`").agg(F.min_by(content, F.xxhash64(content)).alias("_row")).select(f"`{key}`", "_row.*").select(*[f"`{c}`" for c in rows.columns])
    if by is None:
        return one.orderBy(_hash(key, seed), f"`{key}`").limit(each)
    order = Window.partitionBy(f"`{by}`").orderBy(_hash(key, seed), f"`{key}`")
    return one.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= each).drop("_nth")


def within_bytes(rows: DataFrame, by: str, seed: int, most_bytes: int) -> DataFrame:
    """Of a sample (doc_id, text, by): of each value of ``by``, texts in order of a hash of their ids until they make up ``most_bytes``.

    Texts of any length are drawn alike, and stay whole.
    """
    order = Window.partitionBy(by).orderBy(_hash("doc_id", seed), "doc_id")
    before = F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < most_bytes).select("doc_id", "text", by)


def texts_of(docs: DataFrame, chosen: DataFrame, by: str) -> DataFrame:
    """(doc_id, text, by) of the chosen ids (a bounded table), one text for each id."""
    held = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen.select("doc_id", by)), "doc_id")
    return held.groupBy("doc_id", by).agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def labelled(docs: DataFrame, labels: DataFrame, label: str, may_learn: Column, each: int, most_bytes: int, seed: int) -> list:
    """At most ``each`` rows (doc_id, text, y) of either label, from labels that ``may_learn`` allows.

    Only the ids of the sample are sent to the scan of ``docs``, and only its texts, at most
    ``most_bytes`` (and one text) of either label, come back. An id whose labels differ counts for the
    smaller. Rows in a fixed order.
    """
    rows = labels.select(F.col("doc_id"), F.col(f"`{label}`").cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & may_learn)
    rows = rows.groupBy("doc_id").agg(F.min("y").alias("y"))
    counts = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    size = F.when(F.col("y") == 1, counts.get(1, 0)).otherwise(counts.get(0, 0))
    chosen = draw(rows.withColumn("_n", size), "_n", each, seed, "doc_id", "y")
    return sorted(within_bytes(texts_of(docs, chosen, "y"), "y", seed, most_bytes).select("doc_id", "text", "y").collect())
