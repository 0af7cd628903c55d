"""Connected parts by runs and strips against a flood fill."""

import numpy as np
import pytest

from tessella.operators import segments as S


def flood(labels, diagonals):
    """For each pixel of a label map (dict) the first pixel of its part."""
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (diagonals or not (a and b))]
    out = {}
    for start in sorted(labels):
        if start not in out:
            out[start], todo = start, [start]
            while todo:
                y, x = todo.pop()
                for a, b in steps:
                    at = (y + a, x + b)
                    if at in labels and at not in out and labels[at] == labels[start]:
                        out[at] = start
                        todo.append(at)
    return out


def spiral(n):
    """Pixels of a path that winds inwards, with one pixel between its turns."""
    on, (y, x), (dy, dx) = {(0, 0)}, (0, 0), (0, 1)
    inside = lambda p: 0 <= p[0] < n and 0 <= p[1] < n
    while True:
        for _ in range(2):
            a, b = (y + dy, x + dx), (y + 2 * dy, x + 2 * dx)
            if inside(a) and b not in on and a not in on:
                break
            dy, dx = dx, -dy
        else:
            return on
        y, x = a
        on.add(a)


def table(spark, maps):
    return spark.createDataFrame([(n, y, x, v) for n, m in maps.items() for (y, x), v in m.items()], "image_id string, y int, x int, label int").repartition(4)


@pytest.mark.parametrize("diagonals", [True, False])
def test_parts_are_those_of_a_flood_fill(spark, diagonals):
    rng = np.random.default_rng(2)
    maps = {f"r{n}": {(y, x): int(rng.integers(0, n + 1)) for y in range(37) for x in range(23) if rng.random() < 0.7} for n in range(3)}
    maps |= {"spiral": dict.fromkeys(spiral(31), 5), "one": {(40, 2): 1}, "checks": {(y, x): (y + x) % 2 for y in range(9) for x in range(9)}}
    for strip in (5, 128):
        got = {n: {} for n in maps}
        for r in S.filled(S.runs(table(spark, maps), diagonals, strip), "label", "component").collect():
            assert maps[r.image_id][r.y, r.x] == r.label
            got[r.image_id][r.y, r.x] = tuple(r.component)
        assert got == {n: flood(m, diagonals) for n, m in maps.items()}


def test_a_long_spiral_takes_few_rounds(spark, monkeypatch):
    n = 400
    on = spiral(n)
    rounds = []
    settled = S.settled
    monkeypatch.setattr(S, "settled", lambda df, name: rounds.append(name) or settled(df, name))
    rows = spark.createDataFrame(list(on), "y int, x int").selectExpr("'s' as image_id", "y", "x", "1 as label")
    out = S.runs(rows, strip=16)
    assert out.select("component").distinct().count() == 1 and out.selectExpr("sum(last - x + 1) as n").first().n == len(on) > n * n // 3
    assert rounds.count("parts") - 1 <= 10


def test_largest_and_empty(spark):
    maps = {"a": dict.fromkeys([(0, 0), (0, 1), (5, 5), (6, 6), (9, 9)], 1)}
    rows = table(spark, maps)
    assert {(r.y, r.x) for r in S.largest_component(rows).collect()} == {(0, 0), (0, 1)}
    assert S.largest_component(rows.limit(0)).count() == S.components(rows.limit(0)).count() == 0
