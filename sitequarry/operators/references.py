"""References to records that do not exist: missing, deleted or later parents.

References and parents are co-partitioned and sorted on (kind, key) and merged in one linear pass by
Spark's sort-merge join. The parents are first folded, with map-side combine, to one row per key that holds the
validity interval of that key, so that the merge is many-to-one and a hot key only lengthens the
reference side, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REF_FIELDS = ("from_entity_id", "to_entity_id", "drawing_id")


def reference_key(value: Column) -> Column:
    """Comparable form of a textual key: outer blanks removed, upper case; blank gives null."""
    bare = F.upper(F.regexp_replace(value, r"^[\s 　]+|[\s 　]+$", ""))
    return F.when(bare != "", bare)


def parent_validity(parents: DataFrame, key: str, kind: str, textual: bool) -> DataFrame:
    """One row per key: ``live_from``, the earliest creation among rows not deleted (null if all are deleted).

    A live row without created_at counts as having existed always. Null or blank keys are dropped.
    """
    k = reference_key(F.col(key)) if textual else F.col(key).cast("string")
    born = F.coalesce(F.col("created_at").cast("timestamp_ntz"), F.lit("0001-01-01").cast("timestamp_ntz"))
    return (
        parents.select(F.lit(kind).alias("kind"), k.alias("key"), F.when(F.col("deleted_at").isNull(), born).alias("born"))
        .where("key is not null")
        .groupBy("kind", "key")
        .agg(F.min("born").alias("live_from"))
    )


def references(relations: DataFrame) -> DataFrame:
    """Long form: one row per relation row and field that holds a reference (null and blank are none)."""
    each = F.array(
        *(
            F.struct(
                F.lit(f).alias("ref_field"),
                F.lit("drawing" if f == "drawing_id" else "entity").alias("kind"),
                (F.col(f).cast("string") if f == "drawing_id" else reference_key(F.col(f))).alias("key"),
            )
            for f in REF_FIELDS
        )
    )
    return (
        relations.select(F.col("id").alias("relation_row_id"), F.col("created_at").cast("timestamp_ntz").alias("ref_at"), F.explode(each).alias("r"))
        .select("relation_row_id", "ref_at", "r.*")
        .where("key is not null")
    )


def reference_states(relations: DataFrame, entities: DataFrame, drawings: DataFrame) -> DataFrame:
    """Every reference with its state: ``ok``, ``missing``, ``deleted`` or ``late``.

    Columns: relation_row_id, ref_field, key, ref_at, ref_state. Repeated relation rows each come out. A
    reference without created_at is never late. Empty tables give an empty result, or all ``missing``.
    """
    parents = parent_validity(entities, "entity_id", "entity", True).unionByName(parent_validity(drawings, "id", "drawing", False))
    joined = references(relations).join(parents.withColumn("known", F.lit(True)).hint("merge"), ["kind", "key"], "left")
    state = F.when(F.col("known").isNull(), "missing").when(F.col("live_from").isNull(), "deleted").when(F.col("live_from") > F.col("ref_at"), "late").otherwise("ok")
    return joined.select("relation_row_id", "ref_field", "key", "ref_at", state.alias("ref_state"))


def orphans(relations: DataFrame, entities: DataFrame, drawings: DataFrame) -> DataFrame:
    """The references that are not ``ok``: relation_row_id, ref_field, ref_state."""
    return reference_states(relations, entities, drawings).where("ref_state <> 'ok'").select("relation_row_id", "ref_field", "ref_state")


def orphans_by_month(relations: DataFrame, entities: DataFrame, drawings: DataFrame) -> DataFrame:
    """Counts per referring field, month of the reference's created_at ('' where null) and state, ``ok`` included."""
    return (
        reference_states(relations, entities, drawings)
        .groupBy("ref_field", F.coalesce(F.date_format("ref_at", "yyyy-MM"), F.lit("")).alias("month"), "ref_state")
        .agg(F.count(F.lit(1)).alias("n_refs"))
    )
