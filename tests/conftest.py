import tempfile

import pytest
from pyspark.sql import SparkSession

# made at once: columns named at the top of a test module need a session
SESSION = (
    SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    .config("spark.driver.memory", "4g").config("spark.sql.warehouse.dir", "/tmp/larder-test-warehouse").getOrCreate()
)
SESSION.sparkContext.setLogLevel("ERROR")
SESSION.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="larder-"))


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
