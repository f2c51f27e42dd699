"""Session helpers: checkpoint folder and package shipping."""

import pytest

from churnlab.sources import session


def test_existing_checkpoint_dir_is_kept(spark):
    first = session.ensure_checkpoint_dir(spark)
    assert session.ensure_checkpoint_dir(spark) == first
    assert spark.sparkContext.getCheckpointDir() == first


def test_package_is_shipped_once(spark):
    session.ship_package(spark)
    assert spark.sparkContext.applicationId in session._SHIPPED

    def probe(it):
        import churnlab.operators.shap as mod  # imported on the worker
        for pdf in it:
            pdf["ok"] = hasattr(mod, "tree_shap")
            yield pdf[["ok"]]

    out = spark.range(4).mapInPandas(probe, "ok boolean").collect()
    assert all(r["ok"] for r in out)


def test_local_scratch_folder_is_refused_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
