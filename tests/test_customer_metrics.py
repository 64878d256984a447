"""Customer metrics from one grouping of the sales."""

import re
from datetime import date
from decimal import Decimal

from smeltry.plans import gold


def _inputs(spark):
    d = Decimal("2.50")
    fact = [("s1", 1, "p1", date(2024, 1, 1), d), ("s2", 1, "p2", date(2024, 1, 3), d), ("s3", 1, "p9", date(2024, 1, 2), None), ("s4", 2, "p2", date(2024, 1, 1), d), ("s5", None, "p1", date(2024, 1, 1), d)]
    # p2 is current twice, p3 once without a category
    products = [("p1", "a", True), ("p2", "a", True), ("p2", "b", True), ("p2", "c", False), ("p3", None, True)]
    return (
        spark.createDataFrame(fact, "sale_id string, customer_sk long, product_id string, date_id date, total_amount decimal(10,2)"),
        spark.createDataFrame(products, "product_id string, category string, is_current boolean"),
    )


def test_the_fact_is_read_once_and_all_is_counted(spark):
    fact, products = _inputs(spark)
    once = gold.customer_metrics(fact, products)
    leaves = re.findall("LogicalRDD|LocalRelation", once._jdf.queryExecution().optimizedPlan().toString())
    assert len(leaves) == 2
    apart = gold.customer_metrics(fact, products, unique_sales=False)
    assert dict(once.dtypes) == dict(apart.dtypes)
    rows = sorted(map(tuple, once.collect()))
    assert rows == sorted(map(tuple, apart.select(*once.columns).collect()))
    assert [(r[0], r[1], r[2], r[5]) for r in rows] == [(1, 3, Decimal("5.00"), 2), (2, 1, Decimal("2.50"), 2)]
