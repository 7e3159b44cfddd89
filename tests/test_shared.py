import os

import pytest

from repeatloom import shared


class _Off:
    """A session on a cluster without a shared folder."""

    class conf:
        @staticmethod
        def get(key, default=None):
            return default

    class sparkContext:
        master = "spark://host:7077"


def test_no_shared_folder_on_a_cluster_is_an_error():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_dir(_Off)


def test_written_tables_are_dropped(spark):
    n = shared.n_written()
    df = shared.written(spark.range(5), "five")
    path = shared._WRITTEN[-1].removeprefix("file://")
    assert df.count() == 5 and os.path.isdir(path)
    shared.drop_written(spark, n)
    assert not os.path.exists(path) and shared.n_written() == n
