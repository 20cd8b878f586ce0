import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from batchloom.session import package_on_workers

    s = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .config("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else operators with timers never run out of micro-batches
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield package_on_workers(s)
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return DATA
