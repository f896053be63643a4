import pytest

from moodmill.session import checkpoint_dir, local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4, memory="8g")
    checkpoint_dir(session)
    return session
