import pytest

from lodestone.session import local_session, ship
from lodestone.storage import release


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=8, memory="6g", shuffle_partitions=4)
    ship(session)
    yield session
    release(session)
