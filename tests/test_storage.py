import glob
from types import SimpleNamespace

import pytest

from lodestone import storage as S


def test_a_cluster_needs_a_shared_folder():
    bare = SimpleNamespace(get=lambda *_: None)
    spark = SimpleNamespace(conf=bare, sparkContext=SimpleNamespace(getConf=lambda: bare, master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="checkpoint"):
        S.shared_dir(spark)


def test_working_tables_end_with_their_block(spark):
    outer = S.materialize(spark.range(3), "outer")
    with S.working_tables(spark) as folder:
        assert S.materialize(spark.range(5), "inner").count() == 5 and glob.glob(f"{folder}/inner-*")
        with S.working_tables(spark) as nested:
            S.materialize(spark.range(1), "nested")
        assert not glob.glob(f"{nested}/*") and glob.glob(f"{folder}/inner-*")
    assert not glob.glob(f"{folder}/*") and outer.count() == 3
