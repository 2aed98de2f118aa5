import pytest

from millrace.operators.sets import except_all, intersect_all
from tests.test_ordering import same


@pytest.mark.parametrize("portion", [3, 1_000_000])
def test_multisets(spark, portion):
    a = spark.createDataFrame([("x", 1)] * 20 + [("y", None)] * 5 + [("z", 3)], "k string, v int")
    b = spark.createDataFrame([("x", 1)] * 7 + [("y", None)] * 9 + [("w", 4)], "p string, q int")
    same(except_all(a, b, portion), a.exceptAll(b))
    same(intersect_all(a, b, portion), a.intersectAll(b))
