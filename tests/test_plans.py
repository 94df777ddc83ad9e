"""Plans of the registered queries: no product of tables, no row-at-a-time Python. CIVICMILL_FULL=1 looks at all of them."""

import contextlib
import io
import os
import re

import pytest

from civicmill import plans
from tests.conftest import DATA

QUERIES, _ = plans.load_all()
SLOW = {"I14_label_vote", "I17_cold_evaluation", "E17_precision_cutoff", "I15_self_training", "I23_two_tiers"}
NAMES = sorted(QUERIES) if os.environ.get("CIVICMILL_FULL") else [n for i, n in enumerate(sorted(QUERIES)) if i % 8 == 0 and n not in SLOW and not n.startswith("J")]


def formatted(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", NAMES)
def test_plan_has_no_product_and_no_row_python(spark, name):
    plan = formatted(QUERIES[name](spark, DATA))
    assert "CartesianProduct" not in plan
    assert "BatchEvalPython" not in plan
    # a nested-loop join is right only beside a side of one row: a whole-table aggregate
    for join in re.findall(r"BroadcastNestedLoopJoin[^\n]*", plan):
        assert "Aggregate" in plan, (name, join)


def test_history_meets_the_committees_without_a_shuffle(spark):
    from civicmill.operators import records as R
    from civicmill.plans.records import committees
    from civicmill.plans.standins import Tables

    t = Tables(spark, DATA)
    coded = R._coded(t.history, committees(t))
    plan = coded._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan  # null codes, most rows, would meet in one task
    assert committees(t).count() == 24 and coded.count() == t.history.count()
