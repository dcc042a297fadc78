"""Upserts, replacement, cascades, pruning and schema repair of tables, all as joins.

Functions return the new table; writing it is the caller's. Parquet has no MERGE, so a changed
table is the old one without the keys that change, and the new rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNFILED = "Unfiled"


def page(notes: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Newest first."""
    return notes.orderBy(F.desc("created_epoch"), F.desc("note_id")).offset(offset).limit(limit)


def newest_per(notes: DataFrame, by: str, limit: int) -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc("created_epoch"), F.desc("note_id"))
    return notes.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def between(notes: DataFrame, start: int | None, end: int | None, **scope) -> DataFrame:
    """Notes of [start, end), oldest first when ordered by the caller; scope: column=value."""
    out = notes
    if start is not None:
        out = out.where(F.col("created_epoch") >= start)
    if end is not None:
        out = out.where(F.col("created_epoch") < end)
    for column, value in scope.items():
        out = out.where(F.col(column) == value)
    return out


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def replace_children(old: DataFrame, new: DataFrame, parent: str, parents: DataFrame) -> DataFrame:
    """All rows of the given parents go, the new ones come."""
    return old.join(parents.select(parent).distinct(), parent, "left_anti").unionByName(new)


def upsert_keep_edits(old: DataFrame, new: DataFrame, key: str, edit: str = "edit_markdown", flag: str = "edited_by_user") -> DataFrame:
    """New generated columns, but a user's edit stays."""
    o = old.select(F.col(key), F.lit(True).alias("_old"), *[F.col(c).alias(f"_o_{c}") for c in old.columns if c != key])
    both = new.withColumn("_new", F.lit(True)).join(o, key, "full")
    edited = F.coalesce(F.col(f"_o_{flag}"), F.lit(False))

    def take(c: str) -> Column:
        if c == flag:
            return F.when(F.col("_new").isNull(), F.col(f"_o_{c}")).otherwise(edited)
        keep = F.col("_new").isNull() | edited if c == edit else F.col("_new").isNull()
        return F.when(keep, F.col(f"_o_{c}")).otherwise(F.col(c))

    return both.select(key, *[take(c).alias(c) for c in new.columns if c != key])


def get_or_create(old: DataFrame, names: DataFrame, name: str = "name") -> DataFrame:
    """Names that no row has yet, compared by lower-case trimmed form; the first spelling stays."""
    key = F.lower(F.trim(name))
    order = Window.partitionBy("k").orderBy(name)
    fresh = names.withColumn("k", key).withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
    known = old.select(key.alias("k")).distinct()
    return fresh.join(known, "k", "left_anti").drop("k")


def cascade_delete(tables: dict[str, DataFrame], ids: DataFrame, key: str = "note_id") -> dict[str, DataFrame]:
    gone = ids.select(key).distinct()
    return {n: t.join(gone, key, "left_anti") for n, t in tables.items()}


def prune_orphans(notes: DataFrame, links: DataFrame, topics: DataFrame, subjects: DataFrame, contacts: DataFrame, note_contacts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Topics, subjects and contacts without those that nothing refers to and nobody filled in."""
    used = notes.select("topic_id").unionByName(links.select("topic_id")).where("topic_id IS NOT NULL").distinct()
    kept_topics = topics.join(used, "topic_id", "left_semi")
    unfiled = subjects.where("is_unfiled")
    kept_subjects = subjects.where("NOT is_unfiled").join(kept_topics.select("subject_id").distinct(), "subject_id", "left_semi").unionByName(unfiled)
    filled = (F.coalesce(F.trim("email"), F.lit("")) != "") | (F.coalesce(F.trim("phone"), F.lit("")) != "")
    kept_contacts = contacts.where(filled).unionByName(contacts.where(~filled).join(note_contacts.select("contact_id").distinct(), "contact_id", "left_semi"))
    return kept_topics, kept_subjects, kept_contacts


def type_default(kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    if isinstance(kind, T.NumericType):
        return F.lit(0).cast(kind)
    if isinstance(kind, T.StringType):
        return F.lit("")
    return F.lit(None).cast(kind)


def backfill(source: DataFrame, target: DataFrame, key: str, required: list[str]) -> DataFrame:
    """Rows of ``source`` that ``target`` lacks, nulls of required columns filled by type."""
    kinds = {f.name: f.dataType for f in source.schema}
    filled = source.withColumns({c: F.coalesce(F.col(c), type_default(kinds[c])) for c in required})
    return filled.join(target.select(key), key, "left_anti")


def missing_columns(have: T.StructType, want: T.StructType) -> list[T.StructField]:
    names = {f.name for f in have}
    return [f for f in want if f.name not in names]


def reconcile(df: DataFrame, want: T.StructType) -> DataFrame:
    """``df`` with the missing columns of ``want`` as nulls."""
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing_columns(df.schema, want)})


def explode_segments(notes: DataFrame, segments_json: str, body: str, label: str) -> DataFrame:
    """Segments of a JSON list as rows; notes without any get one over their whole length."""
    kind = "array<struct<start:double,end:double,text:string>>"
    parsed = F.filter(F.coalesce(F.from_json(F.col(segments_json), kind), F.array().cast(kind)), lambda s: F.coalesce(F.trim(s["text"]), F.lit("")) != "")
    whole = F.array(F.struct(F.lit(0.0).alias("start"), F.coalesce(F.col("duration"), F.lit(0.0)).alias("end"), F.col(body).alias("text")))
    rows = notes.withColumn("_s", F.when(F.size(parsed) > 0, parsed).otherwise(whole))
    return rows.select("note_id", F.posexplode("_s").alias("pos", "s"), F.coalesce(F.col(label), F.lit("unclassified")).alias("label")).select("note_id", "pos", "s.start", "s.end", F.trim("s.text").alias("text"), "label")


def scalar_metadata(metadata: Column) -> Column:
    """A map without nulls."""
    return F.map_filter(metadata, lambda k, v: v.isNotNull())


def source_label(source: Column) -> Column:
    """Where a note came from, by its stored source."""
    known = {"dummy": "voice", "microphone": "voice", "upload": "ocr", "text": "manual"}
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), source), F.lit("manual"))
