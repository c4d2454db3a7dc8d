import pytest

from lodestone.session import build_session


@pytest.fixture(scope="session")
def spark():
    return build_session(master="local[4]", app="tests", **{"spark.sql.shuffle.partitions": "4", "spark.default.parallelism": "4"})
