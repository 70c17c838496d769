import duckdb
import pytest

from tabularium.session import build_session
from tabularium.tables import TABLE_NAMES, Tables

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[8]", spark__driver__memory="6g", spark__sql__shuffle__partitions="4",
                            spark__ui__showConsoleProgress="false",
                            spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture(scope="session")
def tables(spark):
    return Tables(spark, FOLDER)


@pytest.fixture(scope="session")
def db():
    con = duckdb.connect()
    for name in TABLE_NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con
