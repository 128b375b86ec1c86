import json
from types import SimpleNamespace

import pytest

from cohortweave.session import shared_dir
from cohortweave.sources.store import DatasetStore, read_sites


def test_round_trip(spark, tmp_path):
    store = DatasetStore(spark, str(tmp_path))
    df = spark.createDataFrame([(1,), (2,), (3,)], "numbers int")
    assert store.dataset("numbers") is None
    store.save_dataset("numbers", df)
    assert store.dataset("numbers").exceptAll(df).count() == 0
    assert df.exceptAll(store.dataset("numbers")).count() == 0
    with pytest.raises(Exception, match="exists"):
        store.save_dataset("numbers", df)


def test_documents_are_rows(spark, tmp_path):
    store = DatasetStore(spark, str(tmp_path))
    result = spark.createDataFrame([("b", None), ("a", 1.5)], "name string, value double")
    store.save_document("results", "m1", result)
    raw = spark.read.parquet(store.path("results", "m1"))
    assert raw.columns == ["value"]
    assert sorted(json.loads(r["value"])["name"] for r in raw.collect()) == ["a", "b"]
    back = store.document("results", "m1", "name string, value double")
    assert {tuple(r) for r in back.collect()} == {("b", None), ("a", 1.5)}
    assert store.document("results", "m2", "name string") is None
    with pytest.raises(Exception, match="exists"):
        store.save_document("results", "m1", result)
    store.save_document("results", "m1", result.limit(0), replace=True)
    assert store.document("results", "m1", "name string, value double").count() == 0


def test_half_written_tables_do_not_exist(spark, tmp_path):
    store = DatasetStore(spark, str(tmp_path))
    bad = spark.range(4).selectExpr("cast(if(id = 3, 'x', '1') as int) as n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        store.save_dataset("d", bad)
    assert (tmp_path / "datasets" / "d").exists()
    assert store.dataset("d") is None
    store.save_dataset("d", spark.range(2))
    assert store.dataset("d").count() == 2


def test_sites(spark, tmp_path):
    sites = [{"agent_id": f"agent-{i}", "name": f"Agent {i}", "endpoint": "x"} for i in (1, 2, 3)]
    (tmp_path / "agents.json").write_text(json.dumps(sites, indent=2))
    assert read_sites(spark, str(tmp_path / "agents.json")).count() == 3


class Session:
    """What shared_dir asks of a session."""

    def __init__(self, master, settings):
        self.conf = settings
        self.sparkContext = SimpleNamespace(master=master, applicationId=f"{master}-app")


def test_shared_folder_is_what_the_session_names(spark):
    assert shared_dir(Session("yarn", {"spark.checkpoint.dir": "/shared/folder/"})) == "/shared/folder"
    assert shared_dir(Session("local[2]", {"spark.checkpoint.dir": "/shared/folder"})) == "/shared/folder"
    for master in ("yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(Session(master, {}))
    assert shared_dir(Session("local[2]", {})) == shared_dir(Session("local[2]", {}))
    assert shared_dir(spark) == shared_dir(spark)
