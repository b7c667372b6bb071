import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from courtloom.session import build_session

    session = build_session("courtloom-tests", f"local[{os.environ.get('TEST_CPUS', '4')}]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.sql.streaming.metricsEnabled": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
