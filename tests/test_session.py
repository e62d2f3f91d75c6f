"""The shared folder of sessions with and without the setting."""

from types import SimpleNamespace

import pytest

from sitequarry.session import fresh_dir, shared_dir


def _session(master, folder=None):
    conf = SimpleNamespace(get=lambda key, default=None: folder or default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId="app-1"))


def test_the_setting_counts_first():
    assert shared_dir(_session("spark://host:7077", "hdfs://shared")) == "hdfs://shared"
    assert fresh_dir(_session("local[2]", "hdfs://shared/"), "x").startswith("hdfs://shared/x-")


def test_only_a_local_session_gets_a_folder_of_its_own():
    assert shared_dir(_session("local[2]")) == shared_dir(_session("local[2]"))
    with pytest.raises(ValueError):
        shared_dir(_session("spark://host:7077"))
