"""What searches send through the driver: a few numbers for each block, no vectors."""

import re

import numpy as np
import pytest

from photark.llm import hard_negatives, topk


@pytest.mark.parametrize("search", [topk.search, hard_negatives.mine])
def test_no_vectors_are_broadcast(spark, search):
    rng = np.random.default_rng(3)
    rows = [(i, i % 3, rng.normal(size=4).tolist()) for i in range(400)]
    found = search(spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>").repartition(3))
    plan = found._jdf.queryExecution().explainString(found._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    sent = re.findall(r"BroadcastExchange\nInput \[\d+\]: \[(.*)\]", plan)
    assert not [s for s in sent if re.search(r"\b(q_)?(v|ids|rows)#", s)], sent
    assert found.count() > 0
