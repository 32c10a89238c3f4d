"""Anchor chains over many ranges against the sequential rule."""

import random

import pytest

from lodestone.operators import ranges
from lodestone.operators.chains import anchors


@pytest.mark.parametrize(("seed", "n", "step"), [(1, 1, 10), (2, 3, 10), (3, 9, 60), (4, 9, 1000), (5, 13, 5)])
def test_anchors(spark, monkeypatch, seed, n, step):
    """One key has a third of all points or more; ties, null keys, and windows shorter and longer than a range."""
    monkeypatch.setattr(ranges, "RANGE_ROWS", 40)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    try:
        rng = random.Random(seed)
        rows = [(rng.choice(["hot", "hot", "hot", "b", None, f"k{rng.randrange(30)}"]), rng.randrange(0, 700), i) for i in range(500)]
        got = anchors(spark.createDataFrame(rows, "key string, at long, id long").repartition(3), step).collect()
        want, held = {}, {}
        for key, at, i in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
            if key not in held or at >= held[key][0] + step:
                held[key] = (at, i, held[key][2] + 1 if key in held else 0)
            want[i] = (key, at, *held[key])
        assert {r["id"]: (r["key"], r["at"], r["anchor_at"], r["anchor_id"], r["nth"]) for r in got} == want and len(got) == len(rows)
        assert anchors(spark.createDataFrame([], "key string, at long, id long"), step).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_trailing_counts(spark):
    """A hot key, null keys and times, times before 1970, ties, and windows of several lengths."""
    from lodestone.operators.events import offered_load

    rng = random.Random(43)
    rows = [(rng.choice(["hot", "hot", "b", None]), rng.choice([None, *[rng.randrange(-300, 300)] * 9]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "key string, us long, id long")
    for window in (1, 7, 60, 1000):
        want = {i: sum(k == key and (u is us is None or (u is not None and us is not None and us - window < u <= us)) for k, u, _ in rows) for key, us, i in rows}
        assert {r["id"]: r["load"] for r in offered_load(df, window).collect()} == want
