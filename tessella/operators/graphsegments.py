"""Felzenszwalb's graph segmentation by tiles and by rounds of lightest edges.

Taken one after the other, edges from light to heavy join parts of an image while they are no heavier than what either
part allows: its own heaviest edge, plus a scale over its size. A tile of an image goes through the edges of the parts that
are named after its pixels, in that order. From the first edge on that it cannot decide, as a part beyond the tile may join
there, a part is unsure, and so is what could join it; all that is sure comes out as if all edges of the image were taken
one after the other. What is left goes through larger tiles, until an image has so few edges that one tile holds them.

Where a tile would hold too many edges, a round over tables takes its place. An edge that is the lightest of both its parts
comes before all others of these parts, so all such edges are decided at once, and with them what follows from the larger
part on. If a part's lightest edge is heavier than it allows, so are all the others, for good, and they go. Of several edges
between two parts only the lightest can ever count. Edges of equal weight come in an order of hashes, in which no long chain
has to wait for its first link.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.sources.store import dropped, shuffled

#: Edges that a tile holds at most, and pixels of a side of the first tiles.
FEW, SIDE = 8192, 32

#: An edge's weight and place in the order of all, and its parts with their sizes and heaviest edges.
ORDER = ["weight", "order", "ea", "eb"]
ENDS = [f"{end}{c}" for end in "ab" for c in ("", "size", "inner")]
TYPES = "weight double, order long, ea long, eb long, a long, asize long, ainner double, b long, bsize long, binner double"


Fits = Callable[[float, int, float, int, float], bool]
Refused = Callable[[float, int, float, int, float, bool, bool], bool]


class Rule(NamedTuple):
    """When an edge of a weight joins two parts, by size and heaviest edge of each.

    ``refused``: whether it surely does not, when it is only known of each part whether its size and edge are final for this edge
    (else its size can only be larger). ``joins`` says the same as ``fits`` by e, the hub's size and heaviest edge by then
    (hub_size, hub_inner) and those of the part beyond (to_size, to_inner); ``never`` whether an edge can be left out for good, by
    size, inner, least and to_size, to_inner, to_least, where ``least`` is a part's lightest edge.
    """

    fits: Fits
    refused: Refused
    joins: Column
    never: Column


def decided(edges: DataFrame, parts: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round over edges (image_id, a, b, e: weight and order) and parts (image_id, part, size, inner): the edges and parts that
    are left of it, and what has been joined (image_id, old, new).

    Two parts whose lightest edge is the same make a hub of the larger one. Its edges are gone through in order as long as
    each is the lightest of the part beyond, lighter than any other edge of the parts that have just been joined, and joins.
    """
    both = edges.select("image_id", "e", F.explode(F.array(F.struct(F.col("a").alias("part"), F.col("b").alias("to")), F.struct(F.col("b").alias("part"), F.col("a").alias("to")))).alias("p")).select("image_id", "e", "p.*")
    known = both.groupBy("image_id", "part").agg(F.min("e").alias("least"))
    other = both.join(known.select("image_id", "part", "least"), ["image_id", "part"]).where("e > least").groupBy("image_id", "part").agg(F.min("e").alias("second"))
    known = shuffled(known.join(other, ["image_id", "part"], "left").join(parts, ["image_id", "part"]), "lightest")
    beyond = known.select("image_id", F.col("part").alias("to"), *[F.col(c).alias(f"to_{c}") for c in ("size", "inner", "least", "second")])
    seen = shuffled(both.join(known.drop("second"), ["image_id", "part"]).join(beyond, ["image_id", "to"]), "seen")
    larger = F.struct("size", "part") > F.struct(F.col("to_size").alias("size"), F.col("to").alias("part"))
    hubs = seen.where((F.col("e") == F.col("least")) & (F.col("e") == F.col("to_least")) & larger).select("image_id", "part")
    line = W.partitionBy("image_id", "part").orderBy("e")
    before = line.rowsBetween(W.unboundedPreceding, -1)
    own = seen.join(hubs, ["image_id", "part"], "left_semi")
    own = own.select("*", (F.col("size") + F.coalesce(F.sum("to_size").over(before), F.lit(0).cast("long"))).alias("hub_size"), F.coalesce(F.lag("e.weight").over(line), "inner").alias("hub_inner"), F.min("to_second").over(before).alias("bound"))
    fine = (F.col("e") == F.col("to_least")) & (F.col("bound").isNull() | (F.col("e") < F.col("bound"))) & rule.joins
    own = own.withColumn("fine", fine).withColumn("taken", F.min("fine").over(line.rowsBetween(W.unboundedPreceding, 0))).where("taken")
    merged = shuffled(own.select("image_id", "part", "to", (F.col("hub_size") + F.col("to_size")).alias("size"), F.col("e.weight").alias("inner")), "merged")
    gone = merged.select("image_id", F.col("to").alias("old"), F.col("part").alias("new"))
    left = seen.where(~rule.never & (F.col("part") < F.col("to"))).select("image_id", F.col("part").alias("a"), F.col("to").alias("b"), "e")
    for end in ("a", "b"):
        left = left.join(gone.withColumnRenamed("old", end), ["image_id", end], "left").withColumn(end, F.coalesce("new", end)).drop("new")
    left = left.where("a <> b").groupBy("image_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("e").alias("e"))
    grown = merged.groupBy("image_id", "part").agg(F.max("size").alias("s"), F.max("inner").alias("i"))
    stay = parts.join(gone.select("image_id", F.col("old").alias("part")), ["image_id", "part"], "left_anti").join(grown, ["image_id", "part"], "left")
    stay = stay.select("image_id", "part", F.coalesce("s", "size").alias("size"), F.coalesce("i", "inner").alias("inner"))
    out = shuffled(left, "edges"), shuffled(stay, "parts"), gone
    dropped(known, seen)
    return out


def by_rounds(edges: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """A round over flat edges (image_id, ``ORDER``, ``ENDS``): those that are left, and what has been joined (image_id, old, new)."""
    parts = edges.select("image_id", F.explode(F.array(*[F.struct(F.col(c).alias("part"), F.col(f"{c}size").alias("size"), F.col(f"{c}inner").alias("inner")) for c in "ab"])).alias("p")).select("image_id", "p.*").distinct()
    known = shuffled(edges.select("image_id", "a", "b", F.struct(*ORDER).alias("e")), "edges"), shuffled(parts, "parts")
    left, stay, gone = decided(*known, rule)
    dropped(*known)
    for end in "ab":
        left = left.join(stay.select("image_id", F.col("part").alias(end), F.col("size").alias(f"{end}size"), F.col("inner").alias(f"{end}inner")), ["image_id", end])
    return left.select("image_id", "e.*", *ENDS), gone


def gone_through(a: list, b: list, weight: list, size: list, inner: list, sure: list, fits: Fits, refused: Refused) -> tuple[list, list]:
    """The edges that stay undecided when edges between numbered parts are taken in order, and the part that each part has joined;
    ``size``, ``inner`` and ``sure`` are changed to what parts have in the end."""
    parent, left = list(range(len(size))), []

    def root(p: int) -> int:
        while parent[p] != p:
            parent[p] = p = parent[parent[p]]
        return p

    for i, (p, q, w) in enumerate(zip(a, b, weight, strict=True)):
        p, q = root(p), root(q)
        if p == q:
            continue
        if sure[p] and sure[q]:
            if fits(w, size[p], inner[p], size[q], inner[q]):
                p, q = (q, p) if size[p] < size[q] else (p, q)
                parent[q], size[p], inner[p] = p, size[p] + size[q], w
        elif not refused(w, size[p], inner[p], size[q], inner[q], sure[p], sure[q]):
            sure[p] = sure[q] = False
            left.append(i)
    pairs, once = set(), []
    for i in left:
        pair = root(a[i]), root(b[i])
        if pair not in pairs and pair[::-1] not in pairs:
            pairs.add(pair)
            once.append(i)
    return once, [root(p) for p in range(len(parent))]


def place(code: Column) -> tuple[Column, Column]:
    """Row and column of a pixel's number."""
    y = F.shiftright(code + (1 << 31), 32)
    return y, code - F.shiftleft(y, 32)


def tiled(edges: DataFrame, side: int) -> DataFrame:
    """edges with the tiles (ty, tx) of their parts, and whether a tile has both parts (here: 0), a only (1) or b only (2)."""
    at = {c: [F.floor(v / side).cast("int") for v in place(F.col(c))] for c in "ab"}
    tile = lambda c, here: F.struct(at[c][0].alias("ty"), at[c][1].alias("tx"), F.lit(here).alias("here"))
    same = (at["a"][0] == at["b"][0]) & (at["a"][1] == at["b"][1])
    return edges.select("*", F.explode(F.when(same, F.array(tile("a", 0))).otherwise(F.array(tile("a", 1), tile("b", 2)))).alias("t")).select(*edges.columns, "t.*")


def by_tiles(tiles: DataFrame, rule: Rule) -> DataFrame:
    """What tiles leave: edges (here: 0, 1 or 2; of a part beyond the tile nothing is said) and what has been joined (here: 3; a into b)."""
    kind, fits, refused = dict(tiles.dtypes)["image_id"], rule.fits, rule.refused

    def run(key: tuple, table: pa.Table) -> pa.Table:
        c = {n: table[n].to_numpy() for n in [*ORDER, *ENDS, "here"]}
        c = {n: v[np.lexsort([c[o] for o in reversed(ORDER)])] for n, v in c.items()}
        names, ids = np.unique(np.concatenate([c["a"], c["b"]]), return_inverse=True)
        a, b = np.split(ids, 2)
        size, inner, sure = np.zeros(len(names), np.int64), np.zeros(len(names)), np.ones(len(names), bool)
        for ends, end in ((a, "a"), (b, "b")):
            size[ends], inner[ends] = c[f"{end}size"], c[f"{end}inner"]
        sure[b[c["here"] == 1]] = sure[a[c["here"] == 2]] = False
        size, inner = size.tolist(), inner.tolist()
        left, root = gone_through(a.tolist(), b.tolist(), c["weight"].tolist(), size, inner, sure.tolist(), fits, refused)
        left, root, size, inner = np.array(left, np.int64), np.array(root, np.int64), np.array(size, np.int64), np.array(inner)
        old = np.flatnonzero(root != np.arange(len(root)))
        out = {n: [c[n][left], np.zeros(len(old), c[n].dtype)] for n in [*ORDER, "here"]}
        for ends, end, to in ((a, "a", old), (b, "b", root[old])):
            now = root[ends[left]]
            out |= {end: [names[now], names[to]], f"{end}size": [size[now], size[to]], f"{end}inner": [inner[now], inner[to]]}
        out["here"][1] = out["here"][1] + 3
        out = {n: np.concatenate(out[n]) for n in [*ORDER, *ENDS, "here"]}
        first = pa.array([key[0].as_py()] * len(out["here"]), table.schema.field("image_id").type)
        return pa.table({"image_id": first, **{n: pa.array(v) for n, v in out.items()}})

    return tiles.groupBy("image_id", "ty", "tx").applyInArrow(run, f"image_id {kind}, {TYPES}, here int")


def left_by_tiles(found: DataFrame) -> DataFrame:
    """The edges of ``by_tiles``: one between two tiles stays if it does in both, and each tile knows its own part."""
    own = lambda n: F.max(F.when(F.col("here") == (1 if n[0] == "a" else 2), F.col(n))).alias(n)
    between = found.where(F.col("here").isin(1, 2)).groupBy("image_id", *ORDER).agg(*[own(n) for n in ENDS], F.count("*").alias("n")).where("n = 2")
    return found.where("here = 0").drop("here").unionByName(between.drop("n"))


def joined(edges: DataFrame, rule: Rule) -> list[DataFrame]:
    """All that is joined (image_id, old, new), step by step, until all edges (image_id, ``ORDER``, ``ENDS``) are decided."""
    done: list[DataFrame] = []
    level = 0
    while True:
        side = SIDE << level
        load = tiled(edges, side).groupBy("image_id", "ty", "tx").agg(F.count("*").alias("n"), F.count_if(F.col("here") < 2).alias("m"))
        load = shuffled(load.groupBy("image_id").agg(F.max("n").alias("most"), F.sum("m").alias("all")), "load")
        images, many = load.select(F.count("*"), F.count_if((F.col("all") > FEW) & (F.col("most") > FEW))).first()
        if not images:
            return done
        at = edges.hint("merge").join(load, "image_id")
        tiles = tiled(at.where(F.col("all") > FEW).where(F.col("most") <= FEW), side)
        whole = at.where(F.col("all") <= FEW).select("*", *[F.lit(0).alias(c) for c in ("ty", "tx", "here")])
        found = shuffled(by_tiles(tiles.unionByName(whole), rule), "found")
        done.append(found.where("here = 3").select("image_id", F.col("a").alias("old"), F.col("b").alias("new")))
        left = left_by_tiles(found)
        if many:
            rest, gone = by_rounds(at.where((F.col("all") > FEW) & (F.col("most") > FEW)), rule)
            done.append(gone)
            left = left.unionByName(rest)
        else:
            level += 1
        edges = shuffled(left, "edges")
        dropped(load)


def renamed(names: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """names (image_id, p, part) after parts have been joined step by step."""
    if not steps:
        return names
    to = steps[-1]
    for i, step in enumerate(reversed(steps[:-1]), 1):
        later = step.hint("merge").join(to.select("image_id", F.col("old").alias("new"), F.col("new").alias("last")), ["image_id", "new"], "left")
        to = later.select("image_id", "old", F.coalesce("last", "new").alias("new")).unionByName(to)
        to = to if i % 5 else shuffled(to, "names")
    return names.hint("merge").join(to.withColumnRenamed("old", "part"), ["image_id", "part"], "left").select("image_id", "p", F.coalesce("new", "part").alias("part"))


def graph_segments(pixels: DataFrame, scale: float = 1.0, min_size: int = 20) -> DataFrame:
    """Label map (image_id, y, x, label: from 0 in order of first pixels) of images (image_id, y, x, val from 0 to 255): pixels that
    touch by sides are joined along edges of their difference; then parts under ``min_size`` join along their lightest
    edges."""
    code = lambda y, x: F.shiftleft(y.cast("long"), 32) + x
    rows = shuffled(pixels.select("image_id", "y", "x", (F.col("val") / 255.0).alias("val")), "pixels")
    names = rows.select("image_id", code(F.col("y"), F.col("x")).alias("p")).withColumn("part", F.col("p"))
    offset = F.explode(F.array(F.struct(F.lit(1).alias("dy"), F.lit(0).alias("dx")), F.struct(F.lit(0).alias("dy"), F.lit(1).alias("dx"))))
    sent = rows.withColumn("o", offset).select("image_id", F.struct("y", "x").alias("a"), F.col("val").alias("other"), (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    met = rows.join(sent, ["image_id", "y", "x"])
    weight = F.coalesce(F.abs(F.col("val") - F.col("other")), F.lit(float("-inf")))
    edges = shuffled(met.select("image_id", weight.alias("weight"), F.xxhash64("a", F.struct("y", "x")).alias("order"), code(F.col("a.y"), F.col("a.x")).alias("ea"), code(F.col("y"), F.col("x")).alias("eb")), "edges")
    state = lambda a, b, asize, bsize: [e for n, v, s in (("a", a, asize), ("b", b, bsize)) for e in (F.col(v).alias(n), s.cast("long").alias(f"{n}size"), F.lit(0.0).alias(f"{n}inner"))]
    allowed = lambda inner, size: F.col(inner) + scale / F.col(size)
    grow = Rule(
        lambda w, s, i, t, j: w <= min(i + scale / s, j + scale / t),
        lambda w, s, i, t, j, a, b: (a and not w <= i + scale / s) or (b and not w <= j + scale / t),
        F.col("e.weight") <= F.least(allowed("hub_inner", "hub_size"), allowed("to_inner", "to_size")),
        (F.col("least.weight") > allowed("inner", "size")) | (F.col("to_least.weight") > allowed("to_inner", "to_size")),
    )
    known = edges.where(F.col("weight") > float("-inf")).select("image_id", *ORDER, *state("ea", "eb", F.lit(1), F.lit(1)))
    names = shuffled(renamed(names, joined(known, grow)), "names")
    sized = names.join(names.groupBy("image_id", "part").agg(F.count("*").alias("size")), ["image_id", "part"]).hint("merge")
    near = edges
    for end in "ab":
        near = near.join(sized.select("image_id", F.col("p").alias(f"e{end}"), F.col("part").alias(end), F.col("size").alias(f"{end}size")), ["image_id", f"e{end}"])
    near = near.where("a <> b").where(F.least("asize", "bsize") < min_size)
    near = near.select("image_id", F.struct(*ORDER).alias("e"), *[F.when(F.col("a") < F.col("b"), F.struct(F.col(c).alias("part"), F.col(f"{c}size").alias("size"))).otherwise(F.struct(F.col(d).alias("part"), F.col(f"{d}size").alias("size"))).alias(c) for c, d in ("ab", "ba")])
    near = near.groupBy("image_id", "a", "b").agg(F.min("e").alias("e")).select("image_id", "e.*", *state("a.part", "b.part", F.col("a.size"), F.col("b.size")))
    is_small = lambda c: F.least(c, "to_size") < min_size
    merge = Rule(lambda w, s, i, t, j: min(s, t) < min_size, lambda w, s, i, t, j, a, b: min(s, t) >= min_size, is_small("hub_size"), ~is_small("size"))
    names = shuffled(renamed(names, joined(shuffled(near, "edges"), merge)), "names")
    first = names.groupBy("image_id", "part").agg(F.min("p").alias("first"))
    number = first.select("image_id", "part", (F.row_number().over(W.partitionBy("image_id").orderBy("first")) - 1).cast("int").alias("label"))
    y, x = (v.cast("int") for v in place(F.col("p")))
    return names.join(number, ["image_id", "part"]).select("image_id", y.alias("y"), x.alias("x"), "label")
