"""Queries over tables whose last image lacks patches, as it does when their number is not a multiple of an image's."""

import pytest
from pyspark.sql import functions as F

from tessella.plans.catalog import ORACLE, QUERIES
from tests.comparing import duck, duck_rows, spark_rows

NAMES = ["p8_gaussian_blur", "p2_crop_to_grid", "p11_preprocess_chain", "h5_offline_blur", "h5_offline_preprocess", "p24_crop_black_border", "v9_augmented_views", "s1_image_pixels", "h4_cut_images"]


@pytest.fixture(scope="module")
def incomplete(spark, sf_dir, tmp_path_factory):
    """Images 0, 1 and 33 to 35, the last with 56 of its 100 patches; those from 33 on are dark where borders are cut."""
    folder = tmp_path_factory.mktemp("incomplete")
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id < 456")
    far = rows.withColumn("vec_id", F.when(F.col("vec_id") >= 200, F.col("vec_id") + 3100).otherwise(F.col("vec_id")))
    far.coalesce(1).toPandas().to_parquet(folder / "embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, incomplete, name):
    names, rows = spark_rows(QUERIES[name](spark, incomplete))
    expected_names, expected = duck_rows(duck(incomplete), ORACLE[name])
    assert rows and names == expected_names
    assert rows == expected
