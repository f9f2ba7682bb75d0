import pytest


@pytest.fixture(scope="session")
def workers(spark):
    from partner_analytics.llm.common import ship

    return ship(spark)


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
