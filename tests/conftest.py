import json
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pactlake.schemas import CHECK_RUNS, SCHEMA_DOCS  # noqa: E402
from pactlake.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
    )
    session = configure(builder).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def docs_of(spark):
    """(contract, version number, document or text) rows as schema_docs."""

    def build(*rows):
        data = [
            (c, f"v{n}", n, d if isinstance(d, (str, type(None))) else json.dumps(d), None)
            for c, n, d in rows
        ]
        return spark.createDataFrame(data, SCHEMA_DOCS)

    return build


@pytest.fixture(scope="session")
def runs_of(spark):
    names = [part.split()[0] for part in CHECK_RUNS.split(", ")]

    def build(*rows):
        return spark.createDataFrame(
            [tuple(row.get(name) for name in names) for row in rows], CHECK_RUNS
        )

    return build


STATION_V1 = {
    "type": "object",
    "properties": {
        "station": {"type": "integer"},
        "quality": {"type": "string", "enum": ["raw", "clean"]},
        "level": {"type": "number", "nullable": True},
    },
    "required": ["quality", "station"],
}
# One optional field and one enum value more.
STATION_V2 = {
    "type": "object",
    "properties": {
        **STATION_V1["properties"],
        "quality": {"type": "string", "enum": ["clean", "raw", "suspect"]},
        "unit": {"type": ["null", "string"]},
    },
    "required": ["station", "quality"],
}
PACKS = json.dumps(
    {
        "packs": {
            "strict": {"rules": {"enum-value-added": "BREAKING"}},
            "relaxed": {"rules": {"ENUM_VALUE_ADDED": "IGNORE"}},
        }
    }
)
