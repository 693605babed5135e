from types import SimpleNamespace

import pytest

from lodestrata.sources.checkpoints import shared_dir


def session(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default=None: folder or default), sparkContext=SimpleNamespace(master=master))


def test_the_named_folder_is_used_and_a_cluster_needs_one():
    assert shared_dir(session("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session("spark://host:7077"))
    own = shared_dir(session("local[2]"))
    assert own.startswith("file:///") and shared_dir(session("local[2]")) == own
