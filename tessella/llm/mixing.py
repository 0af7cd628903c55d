"""Mixing sources to target weights by systematic sampling.

Each source has a target number of words; a document's expected copies are its source's target over its
source's words. Expected copies are summed along each source in order of size, one random offset a source is
added, and a document is emitted once for each integer that its interval crosses. Neighbours in that order
are of like size, so what is taken stays close to the target. Where single documents are a good part of a source
that is not close enough: the levels of size that hold more than ``LARGE`` of the target in each document are
sampled first, and the expected copies of the other documents make up for what these took.

The prefix sums are distributed in two steps: a source is cut into levels by leading bits of the size, and a
level into strata of some ``STRATUM_ROWS`` rows by a hash of the id. Levels are summed along their source, strata
along their level, and rows are ranked within their stratum, so no group grows with a source's share of the
rows. Sources are assumed to form a catalogue: one row each is handled in a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.llm.storage import discard, stash

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a stratum is meant for; leading bits of the size that make a level.
STRATUM_ROWS, LEVEL_BITS = 1000, 5
#: Share of a source's target that makes a document a large one.
LARGE = 0.02


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def unit_hash(text: Column) -> Column:
    """The first 32 bits of the text's MD5, as a long."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", as_col: str = "mix") -> DataFrame:
    """docs' rows and columns and, in a struct column ``as_col``, which must be new: size, source_size, target, copies.

    size: words of the text, null 0. Sources in code point order, null last, weigh ``weights`` in turn and
    share ``share`` of all words; a target stops at ``cap`` times its source's words and the excess is shared
    anew by weight until none is above. copies is at most ``cap`` (rounded up). Runs over the same rows
    agree: rows are ordered by size, id and text. A source without words has target 0 and no copies.
    """
    if as_col in docs.columns:
        raise ValueError(f"docs has a column {as_col}; name another one")
    own = f"{as_col}."
    while any(c.startswith(own) for c in docs.columns):
        own += "."
    keys = ["source", "none", "level"]
    col = lambda name: F.col(f"`{own}{name}`")
    named = lambda df, *names: df.withColumnsRenamed({k: f"{own}{k}" for k in names})
    source = F.col(f"`{source_col}`").cast("string")
    shift = f"greatest(length(bin(`{own}size`)) - {LEVEL_BITS}, 0)"
    rows = docs.withColumn(f"{own}size", words(F.col(f"`{text_col}`"))).withColumns(
        {
            f"{own}source": F.coalesce(source, F.lit("")),
            f"{own}none": source.isNull(),
            f"{own}level": F.expr(f"shiftleft({shift}, {LEVEL_BITS}) + shiftright(`{own}size`, {shift})").cast("int"),
        }
    )
    levels = stash(rows.groupBy(*[col(k).alias(k) for k in keys]).agg(F.count("*").alias("n"), F.sum(col("size")).alias("n_words"), F.min(col("size")).alias("least")), "levels")
    wide = levels.groupBy("source", "none").agg(F.sum("n_words").alias("source_size"))
    order = W.orderBy("none", "source")
    wide = wide.withColumn("place", F.row_number().over(order)).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int")))
    limit = F.col("source_size") * cap
    fill = W.orderBy(limit / F.col("weight"), "place")
    full, rest = F.coalesce(F.sum(limit).over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), F.sum("weight").over(fill.rowsBetween(0, W.unboundedFollowing))
    wide = wide.withColumn("fill", (F.sum("source_size").over(W.partitionBy()) * F.lit(share) - full) / rest)
    fill = F.max(F.when(F.col("fill") * F.col("weight") < limit, F.col("fill"))).over(W.partitionBy())
    wide = wide.select("source", "none", "source_size", F.coalesce(F.least(limit.cast("double"), fill * F.col("weight")), limit.cast("double")).alias("target"))
    offset = unit_hash(F.concat(F.lit(f"{seed}:"), F.col("none").cast("string"), F.lit(":"), F.col("source"))) / F.lit(4294967296.0)
    # what the levels of large documents take, and the expected copies of the others
    at = levels.join(wide.withColumn("offset", offset), ["source", "none"]).withColumn("large", F.col("least") > F.lit(LARGE) * F.col("target"))
    whole = W.partitionBy("source", "none")
    at = at.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("source", "none", "large").orderBy("level").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    at = at.withColumn("rate", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)))
    upto = lambda rate, n: F.floor(rate * n + F.col("offset"))
    taken = (upto(F.col("rate"), F.col("before") + F.col("n")) - upto(F.col("rate"), F.col("before"))) * F.col("n_words")
    at = at.withColumn("taken", F.sum(F.when(F.col("large"), F.floor(taken / F.col("n")))).over(whole)).withColumn("others", F.sum(F.when(~F.col("large"), F.col("n_words"))).over(whole))
    rest = F.greatest(F.least((F.col("target") - F.coalesce("taken", F.lit(0))) / F.nullif("others", F.lit(0)), F.lit(float(cap))), F.lit(0.0))
    at = at.withColumn("rate", F.when(F.col("large") | F.col("taken").isNull(), F.col("rate")).otherwise(F.coalesce(rest, F.lit(0.0))))
    at = stash(at.select(*keys, "before", "source_size", "target", "rate", "offset", F.ceil(F.col("n") / STRATUM_ROWS).alias("buckets")), "rates")
    # strata; each row learns in how many its level is cut
    dealt = rows.join(named(at.select(*keys, "buckets"), *keys, "buckets"), [f"{own}{k}" for k in keys])
    dealt = dealt.withColumn(f"{own}bucket", unit_hash(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))) % col("buckets"))
    strata = [*keys, "bucket"]
    counts = dealt.groupBy(*[col(k).alias(k) for k in strata]).agg(F.count("*").alias("n"))
    within = W.partitionBy(*keys).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("ahead", F.coalesce(F.sum("n").over(within), F.lit(0)))
    starts = counts.join(at, keys).select(*strata, F.struct((F.col("before") + F.col("ahead")).alias("before"), "source_size", "target", "rate", "offset").alias("of"))
    starts = stash(named(starts, *strata, "of"), "starts")
    # rows are ranked and joined under one partitioning by stratum, so texts are shuffled once
    ranked = W.partitionBy(*[col(k) for k in strata]).orderBy(col("size"), F.col(f"`{id_col}`"), F.xxhash64(F.col(f"`{text_col}`")))
    joined = dealt.withColumn(f"{own}rank", F.row_number().over(ranked)).join(starts, [f"{own}{k}" for k in strata])
    of, rank = col("of"), col("rank")
    upto = lambda r: F.floor(of["rate"] * (of["before"] + r) + of["offset"])
    out = F.struct(col("size").alias("size"), of["source_size"].alias("source_size"), of["target"].alias("target"), (upto(rank) - upto(rank - 1)).alias("copies"))
    discard(levels)
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], out.alias(as_col))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """docs with each row as often as its copies: see ``mix``. All columns of docs stay, whatever their names."""
    own = "mix of " + " ".join(docs.columns)
    copies = F.col(f"`{own}`.copies")
    return mix(docs, as_col=own, **how).where(copies > 0).withColumn(own, F.explode(F.sequence(F.lit(1), copies.cast("int")))).drop(own)


#: DuckDB SQL for doc_id, size, source_size, target, taken over documents.
ORACLE = rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS source, source IS NULL AS none,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS hash
  FROM documents),
e AS (SELECT *, greatest(length(bin(size)) - {LEVEL_BITS}, 0) * {1 << LEVEL_BITS} + (size >> greatest(length(bin(size)) - {LEVEL_BITS}, 0)) AS level FROM d),
l AS (SELECT source, none, level, count(*) AS n, sum(size)::BIGINT AS n_words, min(size) AS least FROM e GROUP BY ALL),
s AS (SELECT source, none, sum(n_words)::BIGINT AS source_size, row_number() OVER (ORDER BY none, source) AS place FROM l GROUP BY source, none),
w AS (SELECT *, [3, 1, 2][((place - 1) % 3 + 1)::INT] AS weight FROM s),
f AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5
    - coalesce(sum(2 * source_size) OVER (ORDER BY (2 * source_size)::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(weight) OVER (ORDER BY (2 * source_size)::DOUBLE / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS fill
  FROM w),
t AS (
  SELECT source, none, source_size, coalesce(least((2 * source_size)::DOUBLE,
    (max(CASE WHEN fill * weight < 2 * source_size THEN fill END) OVER ()) * weight), (2 * source_size)::DOUBLE) AS target,
    ('0x' || substr(md5('0:' || none::VARCHAR || ':' || source), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS shift
  FROM f),
a AS (SELECT l.*, source_size, target, shift, coalesce(target / nullif(source_size, 0), 0) AS rate, least > {LARGE}::DOUBLE * target AS large FROM l JOIN t USING (source, none)),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source, none, large ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM a),
c AS (
  SELECT *, (sum(CASE WHEN large THEN floor(((floor(rate * (before + n) + shift) - floor(rate * before + shift))::BIGINT * n_words)::DOUBLE / n)::BIGINT END) OVER o)::BIGINT AS taken,
    (sum(CASE WHEN NOT large THEN n_words END) OVER o)::BIGINT AS others
  FROM b WINDOW o AS (PARTITION BY source, none)),
u AS (SELECT * REPLACE (CASE WHEN large OR taken IS NULL THEN rate ELSE coalesce(greatest(least((target - taken) / nullif(others, 0), 2.0), 0.0), 0.0) END::DOUBLE AS rate) FROM c),
r AS (
  SELECT e.doc_id, e.size, u.source_size, u.target, u.rate, u.shift, u.before
    + row_number() OVER (PARTITION BY e.source, e.none, e.level ORDER BY hash % ((u.n + {STRATUM_ROWS - 1}) // {STRATUM_ROWS}), e.size, doc_id) AS rank
  FROM e JOIN u ON e.source = u.source AND e.none = u.none AND e.level = u.level)
SELECT doc_id, size, source_size, target, ((floor(rate * rank + shift) - floor(rate * (rank - 1) + shift))::BIGINT * size)::BIGINT AS taken FROM r
"""
