import sys
import tempfile
import warnings
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
warnings.filterwarnings("ignore", category=FutureWarning)

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from passage.session import local_session
    s = local_session(cores="*", shuffle_partitions=8,
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="passage-test-ckpt-")})
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_str():
    return tempfile.mkdtemp(prefix="passage-test-")
