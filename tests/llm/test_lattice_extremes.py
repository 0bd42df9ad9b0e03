"""Cosines of vectors whose squares leave the range of doubles, against exact fractions."""

from fractions import Fraction

import pytest

from vigilake.llm import lattice


@pytest.mark.parametrize("scale", [1e200, 1e-200, 1e-320, 1.0, 1e307])
def test_scale_does_not_matter(spark, scale):
    rest = [0.0] * 62
    rows = [(1, [1.0, 1.0, *rest]), (2, [0.6, 1.4, *rest]), (3, [1.0, 1.1, *rest]), (4, [-1.0, -1.0, *rest]), (5, [2.0, 2.0, *rest])]
    rows = [(i, [x * scale for x in v]) for i, v in rows]
    got = {r.vec_id: r for r in lattice.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}

    def linked(v, w):
        dot, a, b = (sum(Fraction(x) * Fraction(y) for x, y in zip(*p)) for p in ((v, w), (v, v), (w, w)))
        return dot > 0 and dot * dot >= Fraction(95, 100) ** 2 * a * b

    for i, v in rows:
        assert got[i].n_links == sum(linked(v, w) for j, w in rows if j != i)
