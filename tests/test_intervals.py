from datetime import date

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sitequarry.operators import intervals as I


def brute(rows):
    out = []
    for key in {r[0] for r in rows}:
        days = sorted({d for k, a, b in rows if k == key for d in range(a, b + 1)})
        runs = []
        for d in days:
            if runs and d == runs[-1][1] + 1:
                runs[-1][1] = d
            else:
                runs.append([d, d])
        out += [(key, "period", a, b) for a, b in runs] + [(key, "gap", x[1] + 1, y[0] - 1) for x, y in zip(runs, runs[1:])]
    return sorted(out)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(-40, 300), st.integers(0, 90)), max_size=25))
def test_against_days(spark, rows):
    rows = [(k, a, a + n) for k, a, n in rows]
    df = spark.createDataFrame(rows + rows[:3], "key string, first int, last int")
    assert sorted(map(tuple, I.periods_and_gaps(df, ["key"], shard_days=16).collect())) == brute(rows)


def test_hot_entity(spark):
    df = spark.range(30_000).selectExpr("'k' as key", "cast(id % 1000 * 2 as int) as first", "cast(id % 1000 * 2 as int) as last")
    got = I.periods_and_gaps(df, ["key"])
    assert got.where("kind = 'period'").count() == 1000 and got.where("kind = 'gap'").count() == 999


def test_tasks(spark):
    schema = "task_id long, work_package string, planned_start date, planned_end date, actual_start date, actual_end date, first int"
    d = date.fromisoformat
    rows = [
        (1, "w", d("2024-01-01"), d("2024-01-03"), None, d("2024-01-01"), 1), (2, "w", d("2024-01-04"), d("2024-01-04"), d("2024-02-02"), d("2024-02-01"), 1),
        (3, "w", d("2024-01-08"), d("2024-01-09"), d("2024-03-01"), d("2024-03-01"), 1), (4, None, d("2024-01-01"), d("2024-01-03"), None, None, 1), (1, "w", d("2024-01-01"), d("2024-01-03"), None, d("2024-01-01"), 1),
    ]
    got = sorted(map(tuple, I.task_periods(spark.createDataFrame(rows, schema)).collect()))
    assert got == [
        ("w", "actual", "period", "2024-03-01", "2024-03-01"), ("w", "planned", "gap", "2024-01-05", "2024-01-07"),
        ("w", "planned", "period", "2024-01-01", "2024-01-04"), ("w", "planned", "period", "2024-01-08", "2024-01-09"),
    ]
    assert I.task_periods(spark.createDataFrame([], schema)).count() == 0
    assert I.coverage(spark.createDataFrame(rows, schema)).where("track = 'planned'").first()[2:] == (2, 1, 6, 3)


@pytest.mark.parametrize("width", [1, 7, 64])
def test_width_does_not_matter(spark, width):
    df = spark.createDataFrame([("a", 0, 200), ("a", 201, 202), ("a", 210, 211)], "key string, first int, last int")
    assert sorted(map(tuple, I.periods(df, ["key"], width).collect())) == [("a", 0, 202), ("a", 210, 211)]
