import random

from millrace.operators.bands import band_join

NAN = float("nan")


def test_first_band_of_each_point(spark):
    rng = random.Random(2)
    values = [rng.randint(0, 300) / 3 for _ in range(400)] + [50.0] * 900 + [None, NAN, -5.0, 1e9]
    bands = [(i, x, x + rng.choice([0.0, 1.0, 7.0, 60.0, -2.0])) for i, x in enumerate(rng.randint(0, 300) / 3 for _ in range(120))]
    bands += [(500, None, 9.0), (501, 9.0, None), (502, NAN, 1.0), (503, 2.0, 3.0)]
    rng.shuffle(bands)
    points = spark.createDataFrame(list(enumerate(values)), "p long, v double")
    held = spark.createDataFrame(bands, "band long, low double, high double")
    want = {}
    for p, v in enumerate(values):
        own = [b for b, lo, hi in bands if None not in (v, lo, hi) and lo <= v < hi]
        want[p] = min(own, default=None)
    for rows in (20, 1_000_000):
        got = band_join(points, held, "v", "low", "high", ["band"], rows_per_task=rows).collect()
        assert len(got) == len(values) and {r["p"]: r["band"] for r in got} == want
    assert band_join(points.where("false"), held, "v", "low", "high", ["band"]).count() == 0
    none = band_join(points, held.where("false"), "v", "low", "high", ["band"]).collect()
    assert len(none) == len(values) and all(r["band"] is None for r in none)
