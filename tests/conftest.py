import pytest

from recollect.runtime import session


@pytest.fixture(scope="session")
def spark():
    s = session("local[4]", **{"spark.sql.shuffle.partitions": "2", "spark.sql.maxMetadataStringLength": "4000", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    return s
