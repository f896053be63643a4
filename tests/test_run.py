from dataclasses import replace

import pytest

from moodmill.catalog import all_queries
from moodmill.plans.distill import DistillConfig
from moodmill.plans.run import RunConfig, assert_budgets

CFG = RunConfig("corpus", "out", "r", "t@v1", "a@v1")


def test_budgets_are_refused_before_any_work():
    assert_budgets(CFG)
    assert_budgets(replace(CFG, max_sequences=10**12, aspect_pairs=10**12))
    for bad in (
        replace(CFG, max_sequences=0), replace(CFG, mine_docs=-1), replace(CFG, aspect_pairs=0),
        replace(CFG, distill=DistillConfig(aspect_fraction=0.6)),
    ):
        with pytest.raises(ValueError):
            assert_budgets(bad)


def test_second_run_reuses_every_stage(spark):
    run = all_queries()["run_full_training"].run(spark, "/root/testdata/sf0.001")
    stages = {r["stage"]: r["value"] for r in run.collect()}
    assert stages["prep kept"] == stages["label total"] > 50
    assert stages["label again"] == stages["aspect pairs again"] == 0
    assert stages["aspect pairs"] > 0 and 0 <= stages["agreement"] <= 1
