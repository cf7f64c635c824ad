from types import SimpleNamespace

import pytest

from framefusion.llm.storage import shared_folder


def session(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder, set=lambda key, value: None), sparkContext=SimpleNamespace(master=master))


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://https://host", "local-cluster[2,1,1024]"])
def test_a_cluster_must_name_its_folder(master):
    with pytest.raises(ValueError):
        shared_folder(session(master))
    assert shared_folder(session(master, "hdfs://shared")) == "hdfs://shared"


def test_a_local_session_gets_one():
    assert shared_folder(session("local[4]")) and shared_folder(session("local"))
