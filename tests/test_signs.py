"""Arrays of rounded numbers equal those of SQL down to the sign of zero, which comparing.plain() would level."""

import pytest

from tessella.plans.catalog import ORACLE, QUERIES
from tests.comparing import duck

NAMES = ["b4_segment_features", "p27_l2_normalise", "p29_feature_fusion"]


@pytest.fixture(scope="module")
def faint(spark, tmp_path_factory):
    """Vectors whose numbers lie around zero, most of them too near to it to be kept by rounding."""
    folder = tmp_path_factory.mktemp("faint")
    rows = [(i, [1.0, *[s * 10.0 ** -(e - i % 3) for s in (-1, 1) for e in range(16, 9, -1)], -0.0, *[0.0] * 48], i % 3) for i in range(6)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    table.coalesce(1).toPandas().to_parquet(folder / "embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_zeros_keep_their_sign(spark, faint, name):
    df = QUERIES[name](spark, faint)
    con = duck(faint)
    listed = ", ".join(f'"{c}"' for c in df.columns)
    expected = [repr(r) for r in con.sql(f"SELECT {listed} FROM ({ORACLE[name]})").fetchall()]
    assert any("-0.0," in r for r in expected)
    assert sorted(repr(tuple(r)) for r in df.collect()) == sorted(expected)
