import pytest

from claimlake.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                            spark__driver__memory="8g", spark__sql__streaming__stateStore__minDeltasForSnapshot="2")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def hot(spark):
    """Every key with more than a handful of rows counts as hot."""
    def set_rows(n: int):
        spark.conf.set("spark.claimlake.skew.hotRows", str(n))
    yield set_rows
    spark.conf.unset("spark.claimlake.skew.hotRows")


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"
