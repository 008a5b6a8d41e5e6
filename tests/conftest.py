import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from snapledger.plans import gold, silver  # noqa: E402,F401  (registers the models)
from snapledger.plans.registry import Context  # noqa: E402
from snapledger.session import build_session  # noqa: E402
from snapledger.sources.catalog import OVERRIDES_SCHEMA, read_seed, read_source  # noqa: E402
from tests import tree  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "snapledger-tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("tables")),
            "spark.driver.memory": "4g",
            "spark.driver.bindAddress": "127.0.0.1",
            "spark.driver.host": "127.0.0.1",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def landed(tmp_path_factory):
    root = tmp_path_factory.mktemp("landed")
    tree.write(root)
    return str(root)


@pytest.fixture(scope="session")
def ctx(spark, landed, tmp_path_factory):
    warehouse = tmp_path_factory.mktemp("warehouse")
    return Context(
        spark,
        lambda name: read_source(spark, landed, name),
        str(warehouse),
        lambda name: read_seed(spark, f"{landed}/{name}.csv", OVERRIDES_SCHEMA),
    )
