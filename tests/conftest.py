import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from parcelworks.session import session

    made = session("tests", master="local[4]", shuffle_partitions=4, memory="4g")
    made.sparkContext.setLogLevel("ERROR")
    if not made.sparkContext.getCheckpointDir():
        made.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield made
    made.stop()
