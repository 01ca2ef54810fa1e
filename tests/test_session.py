from types import SimpleNamespace

import pytest

from tidemark.session import SETTINGS, apply_settings, new_work_dir


def session(master, shared=None):
    conf = SimpleNamespace(get=lambda key, default: shared or default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


def test_work_goes_to_the_shared_folder():
    for master in ("local[4]", "spark://host:7077"):
        found = new_work_dir(session(master, "hdfs:///shared/"), "x")
        assert found.startswith("hdfs:///shared/tidemark-x-")
    assert new_work_dir(session("yarn", "s3a://b/c"), "x") != new_work_dir(session("yarn", "s3a://b/c"), "x")


def test_only_a_local_session_uses_this_machine():
    assert "tidemark-x-" in new_work_dir(session("local[*]"), "x")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        new_work_dir(session("yarn"), "x")


def test_settings(spark):
    apply_settings(spark)
    assert all(spark.conf.get(key) == value for key, value in SETTINGS.items())
