"""Tables of pixels and parts are not sent to the driver to be broadcast."""

import re

import pytest
from pyspark.sql import functions as F

from tessella.operators import eigen, graphsegments, randomfield, segments, superpixels

WORK = {
    "c14_crf": (randomfield, lambda p: randomfield.refined(p.select("image_id", "y", "x", (F.col("x") % 3).alias("label")), p, 3, iterations=1)),
    "c15_slic": (superpixels, lambda p: superpixels.superpixels(p, 4, iterations=2)),
    "c15_felzenszwalb": (graphsegments, lambda p: graphsegments.graph_segments(p, 1.0, 5)),
}


@pytest.mark.parametrize("name", WORK)
def test_no_table_is_broadcast(spark, monkeypatch, name):
    module, work = WORK[name]
    plans = []
    for m in {module, segments}:
        kept = m.shuffled
        monkeypatch.setattr(m, "shuffled", lambda df, n, kept=kept: (plans.append(df._jdf.queryExecution().executedPlan().toString()), kept(df, n))[1])
    y, x = F.floor(F.col("id") / 8), F.col("id") % 8
    pixels = spark.range(64).select(F.lit(1).alias("image_id"), y.cast("int").alias("y"), x.cast("int").alias("x"), (F.col("id") * 37 % 256).cast("int").alias("val"))
    found = work(pixels)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert found.count() == 64
    assert any("SortMergeJoin" in p for p in plans)
    assert [line for p in plans if "Broadcast" in p for line in p.split("\n") if "Join" in line or "Scan" in line] == []


def test_tables_of_nodes_are_not_broadcast(spark, monkeypatch):
    plans, kept = [], eigen.settled
    monkeypatch.setattr(eigen, "settled", lambda df, n: (plans.append(df._jdf.queryExecution().executedPlan().toString()), kept(df, n))[1])
    rows = spark.range(40).select(F.lit(0).alias("g"), F.col("id").alias("i"), F.array((F.col("id") % 3) * 4.0, F.col("id") / 40).alias("x"))
    assert eigen.rbf_clusters(rows, 3, 0.5, steps=3).count() == 40
    sent = [line for p in plans for line in p.split("\n") if "BroadcastHashJoin" in line]
    # only what a graph has one row of, at the right, by the graph alone
    assert sent and all(re.search(r"BroadcastHashJoin \[g#\d+\], \[g#\d+\], \w+, BuildRight", line) for line in sent)
