"""Purchase counts and labels of pairs from one grouping of the sales."""

import pytest

from smeltry.plans import features
from smeltry.workload import Workload


@pytest.mark.parametrize("strict", [False, True])
def test_sales_of_pairs_are_grouped_once(spark, sf, strict):
    sales, day = Workload(spark, sf).silver_sales, "2024-01-15"
    once = features.purchases_of_pairs(sales, day, strict)
    apart = features.frequency_features(sales, day).join(features.purchase_labels(sales, day, strict), features.PAIR, "full")
    apart = apart.fillna(0, ["purchase_count_7d", "purchase_count_30d"]).select(*once.columns)
    assert once.count() == apart.count() and once.exceptAll(apart).count() == 0
