import inspect

from churnlab.plans import contract


def test_learning_rates_of_the_reference(spark):
    rows = contract.QUERIES["mlp_learning_rates"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.lr for r in rows) == [0.005, 0.01, 0.05, 0.1]
    assert all(r.kl_mean > 0 and r.test_kl_mean > 0 and 0 <= r.test_accuracy <= 1 for r in rows)


def test_cross_validation_runs_the_epochs_of_the_reference():
    assert inspect.signature(contract._cv_mlp_summary).parameters["epochs"].default == 40
