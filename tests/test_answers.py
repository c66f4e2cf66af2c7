"""Operators of requests and answers, at their edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from almucantar.operators import answers


def test_smoothed_ground_against_least_squares(spark):
    rng = np.random.default_rng(4)
    h, step, sigma = rng.normal(200, 40, 25), 0.5, 1.5
    d = np.arange(len(h)) * step
    expected = []
    for x0 in d:
        w = np.exp(-0.25 * ((d - x0) / sigma) ** 2)  # the root, on either side
        expected.append(np.linalg.lstsq(np.vander(d - x0, 3, increasing=True) * w[:, None], h * w, rcond=None)[0][0])
    got = spark.createDataFrame([(h.tolist(),), ([5.0],), (None,)], "h array<double>").select(answers.smoothed_ground(F.col("h"), step, sigma)).collect()
    assert got[0][0] == pytest.approx(expected, rel=1e-6) and got[1][0] == [5.0] and got[2][0] is None


def test_rules_and_bodies(spark):
    assert [r[0] for r in spark.createDataFrame([("auto",), ("finest",), ("0",), (None,)], "a string").select(answers.area_rule(F.col("a"))).collect()] == ["city", "finest", None, None]
    with pytest.raises(Exception, match="auto, city or finest"):
        spark.createDataFrame([("town",)], "a string").select(answers.area_rule(F.col("a"))).collect()
    bodies = spark.createDataFrame([("{}",), (" {\n} ",), ("{",), ("",), (None,)], "b string")
    assert [r[0] for r in bodies.select(answers.whole_json(F.col("b"))).collect()] == [True, True, False, False, False]
    assert answers.first_field(["Name", "ID"], ["label", "name"], "name") == "Name"
    with pytest.raises(ValueError, match="no column for name"):
        answers.first_field(["ID"], ["label", "name"], "name")


def test_states_and_edges(spark):
    cells = spark.createDataFrame([(1, answers.SEA, 4), (2, answers.FALLBACK, 4), (3, answers.FALLBACK, 1), (3, "fab", 3), (4, answers.SEA, 1), (4, answers.FALLBACK, 1)], "tile int, source string, n int")
    got = {r["tile"]: (r["state"], r["fractions"]) for r in answers.tile_states(cells, "tile").collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "sea", 2: "plain", 3: "built", 4: "built"} and got[3][1]["fab"] == 0.75
    steps = spark.createDataFrame([("a", 1, 5.0, 9.0), ("a", 2, 5.0, 4.6), ("a", 3, 5.0, 4.0), ("b", 1, 5.0, 4.0), ("c", 1, 5.0, 9.0), ("c", 2, None, 9.0)], "edge string, k int, altitude double, horizon double")
    assert {r["edge"]: r["by"] for r in answers.widened(steps, ["edge"], 0.5, 0.5, 1.0, 45.0).collect()} == {"a": 2.0, "b": 0.0, "c": 1.5}
    assert answers.tile_states(cells.limit(0), "tile").count() == 0
