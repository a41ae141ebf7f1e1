"""Queries of vectors return every component of every node."""

import pytest

from conftest import SF
from pomelo.plans import domain as D
from pomelo.plans.catalog import REGISTRY


@pytest.mark.parametrize("name", ["lightgcn_one_layer", "lightgcn_two_layers", "sage_forward", "bpr_training"])
def test_all_components_are_returned(spark, name):
    df = REGISTRY[name].run(spark, SF)
    assert df.columns == ["node", "d", "x"]
    assert df.select("node", "d").distinct().count() == df.count() == sum(D.prepared(spark, SF).sizes()) * D.DIM
