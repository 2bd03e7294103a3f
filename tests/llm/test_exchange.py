from types import SimpleNamespace

import pytest

from tremorlake.llm.exchange import shared_dir


def session(master, folder=None):
    """A session with a master and a checkpoint folder, as far as shared_dir() looks."""
    unset = SimpleNamespace(isDefined=lambda: False)
    made = []
    sc = SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda _: folder), _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset)), setCheckpointDir=made.append)
    return SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda *_: None)), made


def test_no_machine_local_folder_on_a_cluster():
    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[3,2,3000]"):
        with pytest.raises(ValueError):
            shared_dir(session(master)[0])
        assert shared_dir(session(master, "hdfs://x/y")[0]) == "hdfs://x/y"
    s, made = session("local[8]")
    assert shared_dir(s) == made[0]
