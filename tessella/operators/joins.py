"""Joins between stages' tables: by key, and by place where tables have no key in common."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.sources.store import settled


def ranked(rows: DataFrame, order: Sequence[str], name: str = "place") -> DataFrame:
    """rows with their number, from 0, in the given order: rows are dealt out by ranges, sorted and numbered within
    each range, and ranges are counted, so that no task sees them all. Ties may come in any order."""
    spread = rows.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    dealt = settled(spread.withColumn(name, F.monotonically_increasing_id()), "ranked")
    part = F.shiftright(name, 33)
    counts = dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row a range
    return dealt.join(counts.select("part", before.alias("before")), part == F.col("part")).select(*rows.columns, (F.col(name).bitwiseAND(F.lit((1 << 33) - 1)) + F.col("before")).alias(name))


def positional(tables: Sequence[DataFrame], order: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Rows of equal rank side by side, as struct columns ``names``; tables of unequal length fail the job.
    Tables that have a key in common are joined by it (``by_key``)."""
    counts = {t.count() for t in tables}
    if len(counts) > 1:
        raise ValueError(f"tables of unequal length: {sorted(counts)}")
    out = None
    for t, o, n in zip(tables, order, names, strict=True):
        numbered = ranked(t, [o]).select("place", F.struct(*t.columns).alias(n))
        out = numbered if out is None else out.join(numbered, "place")
    return out.drop("place")


def by_key(left: DataFrame, right: DataFrame, key: str = "image_id", strict: bool = True) -> DataFrame:
    """Inner join on the key; with ``strict`` a left row without a partner fails the job."""
    if not strict:
        return left.join(right, key)
    marked = right.withColumn("found", F.lit(True))
    lost = F.raise_error(F.concat(F.lit("no partner for "), F.col(key).cast("string")))
    return left.join(marked, key, "left").withColumn("found", F.when(F.col("found").isNull(), lost.cast("boolean")).otherwise(F.lit(True))).where("found").drop("found")


def updated(left: DataFrame, right: DataFrame, key: str = "image_id") -> DataFrame:
    """One row a key with all columns of both; where both have a column the right one's value wins."""
    both = [c for c in left.columns if c in right.columns and c != key]
    r = right.select(key, *[F.col(c).alias(f"new {c}") for c in both], *[c for c in right.columns if c not in left.columns])
    return left.join(r, key, "left").withColumns({c: F.coalesce(F.col(f"`new {c}`"), F.col(c)) for c in both}).drop(*[f"new {c}" for c in both])


def missing(wanted: DataFrame, have: DataFrame, key: str = "image_id") -> DataFrame:
    """Rows of ``wanted`` whose key ``have`` lacks."""
    return wanted.join(have.select(key).distinct(), key, "left_anti")


def present(wanted: DataFrame, have: DataFrame, key: str = "image_id") -> DataFrame:
    return wanted.join(have.select(key).distinct(), key, "left_semi")


def three_way(images: DataFrame, gt: DataFrame, pred: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """keys, image, gt, pred by name; predictions stand in for missing truth."""
    out = images.join(pred, list(keys)).join(gt, list(keys), "left")
    return out.select(*keys, "image", F.coalesce("gt", "pred").alias("gt"), "pred")


def parameter_grid(over: DataFrame, values: Mapping[str, Sequence]) -> DataFrame:
    """Each row of ``over`` with all combinations of the parameters' values, one column each: a sweep's trials. Value lists are
    short."""
    for name, options in values.items():
        over = over.withColumn(name, F.explode(F.array(*map(F.lit, options))))
    return over
