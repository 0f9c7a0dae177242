import logging
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
if str(ROOT) not in sys.path:
    sys.path.insert(0, str(ROOT))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from sparkloom import create_session
    from sparkloom.session import ship

    logging.getLogger("SQLQueryContextLogger").setLevel(logging.CRITICAL)
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "3g", "spark.sql.warehouse.dir": tempfile.mkdtemp()}
    s = create_session("tests", "local[4]", **conf)
    s.sparkContext.setLogLevel("OFF")
    ship(s)
    yield s
    s.stop()


@pytest.fixture()
def engine(spark):
    from sparkloom.engine import Engine

    for db in spark.catalog.listDatabases():  # tests share a session, not their tables
        if db.name.startswith("p_"):
            spark.sql(f"DROP DATABASE `{db.name}` CASCADE")
    return Engine(spark, tempfile.mkdtemp(), project="project1", dataset="main")
