"""Exact medians and running values over ranges against plain ones."""

import random
import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from boxloom.operators import select


@pytest.mark.parametrize("small,buckets", [(1, 4), (5, 16), (10_000, 1024)])
def test_exact_median(spark, small, buckets):
    rng = random.Random(small)
    rows = [(1, rng.expovariate(1) ** 6) for _ in range(501)] + [(2, float(rng.randrange(4))) for _ in range(400)] + [(3, 5.0)] * 77 + [(4, 1.0), (4, 2.0)] + [(5, rng.choice([-1e300, 1e300, 0.0, 5e-324])) for _ in range(60)] + [(6, -3.5)]
    odd = [(1, None), (1, float("nan")), (7, None), (None, 4.0)]
    got = {r.k: r.median for r in select.exact_median(spark.createDataFrame(rows + odd, "k int, x double"), "k", "x", buckets, small).collect()}
    assert got == {k: statistics.median([x for i, x in rows if i == k]) for k in range(1, 7)}


def test_exact_median_of_nothing(spark):
    assert select.exact_median(spark.createDataFrame([], "k int, x double"), "k", "x").count() == 0


def test_values_carried_over_ranges(spark):
    rng = random.Random(4)
    rows = [(rng.choice("aaaaaab"), rng.random(), k, rng.randrange(5)) for k in range(600)] + [("c", 0.5, 1000, 3)]
    frame = spark.createDataFrame(rows, "g string, x double, id int, n int")
    dealt = select.in_ranges(frame, ["g"], [F.desc("x"), F.asc("id")], 9)
    assert dealt.groupBy("part").count().count() > 4 and dealt.groupBy("part").count().agg(F.max("count")).first()[0] < 250
    told = select.carried(select.carried(dealt, ["g"], {"before": (F.sum("n"), F.sum)}), ["g"], {"after": (F.max("n"), F.max)}, falling=True)
    own = Window.partitionBy("g", "part").orderBy(F.desc("x"), "id")
    upto = told.withColumn("upto", F.coalesce("before", F.lit(0)) + F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    upto = upto.withColumn("best", F.greatest(F.max("n").over(own.rowsBetween(0, Window.unboundedFollowing)), F.coalesce("after", F.lit(0))))
    want = {}
    for g in "abc":
        listed = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        for k, r in enumerate(listed):
            want[r[2]] = (sum(x[3] for x in listed[: k + 1]), max(x[3] for x in listed[k:]))
    assert {r.id: (r.upto, r.best) for r in upto.collect()} == want
