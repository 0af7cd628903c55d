"""Bounded, repeatable samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, modulus: int, held: int) -> Column:
    """True where crc32 of the id as text leaves ``held`` modulo ``modulus``; null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == held, F.lit(False))


def marked(labels: DataFrame, label_col: str, modulus: int, held: int) -> DataFrame:
    """id, label (0 or 1) of every id that is not held out; null labels and ids are left out, of several labels the largest counts."""
    return labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), modulus, held)).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, modulus: int, held: int, per_class: int, class_bytes: int, also: str | None = None) -> DataFrame:
    """id, label, text (and the column ``also``) of up to ``per_class`` documents of each label, 0 and 1.

    Documents are those whose labels are not held out, taken in order of a hash of the id, so that a sample
    is the same on every run; nothing else of it depends on the table's size. A text that would take the bytes of
    what a label has so far, in that order, beyond ``class_bytes`` is skipped, and those after it are looked at all the same. Null labels and ids are left out; of several
    labels of an id the largest counts, of several texts the smallest.
    """
    marks = marked(labels, label_col, modulus, held)
    order = F.xxhash64("id", F.lit(7))
    chosen = None
    for label in (0, 1):
        part = marks.where(F.col("label") == label).orderBy(order, "id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    rest = [F.col(f"`{also}`").cast("string").alias(also)] if also else []
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *rest)
    first = F.min(F.struct("text", *[also] * bool(also))).alias("r")
    rows = rows.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(first).select("id", "label", "r.*")  # at most 2 * per_class ids
    rows = rows.withColumns({"place": order, "bytes": F.octet_length("text").cast("long")})
    line = F.sort_array(F.collect_list(F.struct("place", "id", "bytes")))  # at most per_class rows
    none = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<long>").alias("ids"))
    take = lambda s, r: F.when(s["total"] + r["bytes"] <= class_bytes, F.struct((s["total"] + r["bytes"]).alias("total"), F.array_append(s["ids"], r["id"]).alias("ids"))).otherwise(s)
    kept = rows.groupBy("label").agg(line.alias("line")).select(F.explode(F.aggregate("line", none, take)["ids"]).alias("id"))
    return rows.join(F.broadcast(kept), "id", "left_semi").drop("place", "bytes")
