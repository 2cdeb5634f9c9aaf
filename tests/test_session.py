"""The folder that the driver and all executors share."""

import pytest

from tabwright import session


class _Conf:
    def __init__(self, named):
        self.named = named

    def get(self, key, default=None):
        return self.named or default


class _Context:
    def __init__(self, folder):
        self.folder = folder

    def getConf(self):
        return _Conf(None)

    def getCheckpointDir(self):
        return self.folder


class _Session:
    def __init__(self, named=None, folder=None):
        self.conf, self.sparkContext = _Conf(named), _Context(folder)


def test_the_setting_comes_first():
    assert session.shared_folder(_Session("s3a://bucket/shared/", "/other")) == "s3a://bucket/shared"
    assert session.shared_folder(_Session(None, "hdfs:/marks")) == "hdfs:/marks"


def test_without_a_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(_Session())


def test_fresh_folders_differ(spark):
    assert session.fresh_folder(spark, "a") != session.fresh_folder(spark, "a")
