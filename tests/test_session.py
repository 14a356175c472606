from types import SimpleNamespace

import pytest

from catalogspark.session import shared_folder


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://host"])
def test_a_cluster_must_name_its_shared_folder(master):
    conf = SimpleNamespace(get=lambda key, default: default)
    session = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(session)


def test_the_named_folder_is_used(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
