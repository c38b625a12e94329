from types import SimpleNamespace

import pytest

from almagest.session import checkpoint


def test_a_cluster_without_shared_folder_is_an_error():
    """No folder of one machine is used where executors are on others."""
    empty = SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isEmpty=lambda: True))
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]"):
        context = SimpleNamespace(_jsc=SimpleNamespace(sc=lambda: empty), master=master)
        session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda name, default: default))
        with pytest.raises(RuntimeError):
            checkpoint(SimpleNamespace(sparkSession=session))
