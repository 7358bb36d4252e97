import pytest

from lexspark.session import local_session


@pytest.fixture(scope="session")
def spark():
    spark = local_session("8", 3, "4g")
    yield spark


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"
