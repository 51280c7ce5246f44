"""What plans must not do twice, or at all."""

import re

import pytest

from tessera import plans
from tessera.plans import registry

DATA = "/root/testdata/sf0.001"


def logical(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_question_words_are_counted_once(spark):
    assert logical(plans.QUERIES["txt_rq_word_counts"](spark, DATA)).count("Research Question(") == 1


@pytest.mark.parametrize("key", ["win_doubling", "pen_doubling"])
def test_doubling_looks_at_modules_alone(spark, key):
    """Questions are neither tidied nor cut, and rows are dealt to several tasks a core before they are widened."""
    df = plans.QUERIES[key](spark, DATA)
    assert "research_question" not in logical(df) and df.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("key", ["dpo_detach_loss", "win_prime_rloo", "flt_prioritised_downsample"])
def test_tasks_hold_a_bounded_number_of_rows(spark, monkeypatch, key):
    """What sorts rows by group deals them to more tasks as the table grows."""
    monkeypatch.setattr(registry, "TASK_ROWS", 500)
    tasks = -(-spark.read.parquet(f"{DATA}/lineitem.parquet").count() // 500)
    plan = logical(plans.QUERIES[key](spark, DATA))
    assert tasks > 4 and re.search(rf"RepartitionByExpression \[.*\], {tasks}\b", plan)
