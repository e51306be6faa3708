"""Shuffle partitions and read splits follow the size of the input."""

import os

import pytest
from pyspark.sql import functions as F

from croupier.catalog import warehouse
from croupier.session import INPUT_A_PARTITION, MOST_A_TASK, conf_bytes, size_partitions
from croupier.sources.driver_tables import TABLES, input_bytes

SMALL = "/root/testdata/sf0.001"
INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


@pytest.fixture()
def conf(spark):
    keys = [INITIAL, "spark.sql.shuffle.partitions", *MOST_A_TASK]
    before = {k: spark.conf.get(k, None) for k in keys}
    yield spark.conf
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_partitions_grow_in_number_with_the_input(spark, conf):
    conf.set("spark.sql.shuffle.partitions", "4")
    plan = lambda: spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()._jdf.queryExecution().executedPlan().toString()
    for size, parts in ((0, 4), (INPUT_A_PARTITION * 4, 4), (INPUT_A_PARTITION * 10 - 1, 10), (INPUT_A_PARTITION * 60, 60)):
        size_partitions(spark, size)
        assert conf.get(INITIAL) == str(parts) and f", {parts})" in plan()


def test_one_task_takes_no_more_than_the_bound(spark, conf):
    for key, most in MOST_A_TASK.items():
        for given, expected in (("64MB", most), ("1g", most), ("134217728b", most), ("512k", 512 << 10), ("1000", 1000)):
            conf.set(key, given)
            size_partitions(spark, 0)
            assert conf_bytes(conf.get(key)) == expected


def test_a_registered_warehouse_is_sized_by_its_files(spark, conf):
    size = sum(os.path.getsize(f"{SMALL}/{t}.parquet") for t in TABLES)
    assert input_bytes(spark, SMALL) == size
    size_partitions(spark, INPUT_A_PARTITION * 60)  # as a larger input left it
    assert warehouse(spark, SMALL).input_bytes == size
    assert conf.get(INITIAL) == conf.get("spark.sql.shuffle.partitions")
