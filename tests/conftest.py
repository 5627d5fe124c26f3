from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import SparkSession  # noqa: E402

TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[4]").appName("flowbalance-tests")
               .config("spark.sql.shuffle.partitions", "4")
               .config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def recipes(spark):
    from flowbalance.sources import recipes

    return recipes(spark)


@pytest.fixture(scope="session")
def market(spark):
    from flowbalance.sources import market_params

    return market_params(spark)


def by(df, *keys):
    """Collected rows as a dict by key."""
    rows = df.collect()
    pick = (lambda r: r[keys[0]]) if len(keys) == 1 else (lambda r: tuple(r[k] for k in keys))
    found = {pick(r): r for r in rows}
    assert len(found) == len(rows), "keys are not unique"
    return found
