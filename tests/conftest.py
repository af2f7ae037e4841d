import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from tempaudit.session import ROWS_PER_TASK, build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[4]", 4, **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(params=["whole", "pieces"])
def form(request, spark):
    """Run a test with whole runs and with every run cut into small pieces."""
    if request.param == "pieces":
        spark.conf.set(ROWS_PER_TASK, "9")
    yield request.param
    spark.conf.unset(ROWS_PER_TASK)


@pytest.fixture
def series(spark):
    """Samples from {run: [(seconds, value), ...]}."""

    def make(runs, extra=None):
        rows = [(run, int(round(t * 1e6)), i, v) for run, points in runs.items() for i, (t, v) in enumerate(points)]
        df = spark.createDataFrame(rows, "run_id long, us long, seq long, value double")
        return df if extra is None else df.withColumns({k: F.expr(e) for k, e in extra.items()})

    return make
