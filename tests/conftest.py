import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from cairn.session import ensure_checkpoint_dir, reach_from_workers

    settings = {"spark.master": "local[8]", "spark.default.parallelism": "2", "spark.sql.shuffle.partitions": "2", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.memory": "4g"}
    session = SparkSession.builder.config(map=settings).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(session)
    reach_from_workers(session)
    return session
