"""Starts under a limiter against a plain simulation of each key."""

import random

from tessera.plans import sweeps


def test_paced(spark):
    rng = random.Random(3)
    rows = [(k, float(rng.randint(0, 60)), rng.choice([0.5, 9.0, 40.0, None]), i) for i, k in enumerate(rng.choices("ab", k=80))]
    found = sweeps.paced(spark.createDataFrame(rows, "key string, at double, takes double, id int"), 3.0, 4).collect()
    for key in "ab":
        mine = sorted((r for r in found if r["key"] == key), key=lambda r: r["start"])
        assert [r["at"] for r in mine] == sorted(r[1] for r in rows if r[0] == key)
        last, under_way = -10.0, []
        for r in mine:
            at = max(r["at"], last + 3.0)
            while sum(end > at for end in under_way) >= 4:
                at = min(end for end in under_way if end > at)
            assert r["start"] == at
            last = at
            under_way.append(at + (r["takes"] or 0.0))
    assert {r["id"] for r in found} == set(range(80))
