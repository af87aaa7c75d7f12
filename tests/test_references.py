from datetime import datetime as dt

from sitequarry.operators import references as R

REL = "id long, relation_id string, from_entity_id string, to_entity_id string, drawing_id long, created_at timestamp_ntz, key string"
ENT = "id long, entity_id string, created_at timestamp_ntz, deleted_at timestamp_ntz, kind string"
DRA = "id long, created_at timestamp_ntz, deleted_at timestamp_ntz"


def states(spark, relations, entities, drawings):
    # columns that clash with those the operator makes
    f = R.orphans(spark.createDataFrame(relations, REL), spark.createDataFrame(entities, ENT), spark.createDataFrame(drawings, DRA))
    return sorted(map(tuple, f.collect()))


def test_states(spark):
    t1, t2, t3 = dt(2024, 1, 1), dt(2024, 2, 1), dt(2024, 3, 1)
    rel = [
        (1, "r", " a ", "B", 1, t2, "x"), (2, "r", "gone", "dead", 2, t2, "x"), (3, "r", "new", None, 9, t2, "x"), (4, None, "  ", "", None, t2, None),
        (4, None, "gone", "new", None, None, None), (5, "r", "　a", "back", 3, t2, "x"),
    ]
    ent = [(1, "A", t1, None, "k"), (2, "b", None, None, "k"), (3, "dead", t1, t2, "k"), (4, "NEW", t3, None, "k"), (5, "back", t1, t2, "k"), (6, "BACK ", t2, None, "k"), (7, None, t1, None, "k"), (8, " ", t1, None, "k")]
    got = states(spark, rel, ent, [(1, t1, None), (2, t1, t2), (3, t3, None)])
    assert got == [
        (2, "drawing_id", "deleted"), (2, "from_entity_id", "missing"), (2, "to_entity_id", "deleted"), (3, "drawing_id", "missing"), (3, "from_entity_id", "late"), (4, "from_entity_id", "missing"), (5, "drawing_id", "late"),
    ]


def test_empty(spark):
    assert states(spark, [], [], []) == []
    assert states(spark, [(1, "r", "a", None, None, None, None)], [], []) == [(1, "from_entity_id", "missing")]


def test_by_month(spark):
    rel = spark.createDataFrame([(1, "r", "a", "a", None, dt(2024, 5, 2), None), (2, "r", "a", None, None, None, None)], REL)
    got = R.orphans_by_month(rel, spark.createDataFrame([], ENT), spark.createDataFrame([], DRA)).collect()
    assert sorted(map(tuple, got)) == [("from_entity_id", "", "missing", 1), ("from_entity_id", "2024-05", "missing", 1), ("to_entity_id", "2024-05", "missing", 1)]
