"""The manifest: an edit for each commit, as rows.

An edit lists new files with their level, size and key range, deleted files, and
the counters.  The live files are the added ones without the deleted ones.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.model import EDIT


def edit_json(next_table_id: int, sequence_number: int, new_files: list[dict] = (), delete_files: list[dict] = ()) -> str:
    """An edit as one JSON document; empty lists are left out, files go by level."""
    out: dict = {"next_table_id": next_table_id, "sequence_number": sequence_number}
    if new_files:
        out["new_files"] = sorted(new_files, key=lambda f: f["level"])
    if delete_files:
        out["delete_files"] = sorted(delete_files, key=lambda f: (f["level"], f["id"]))
    return json.dumps(out, separators=(",", ":"))


def split_documents(text: str) -> list[str]:
    """The JSON documents of a manifest that joins them with or without line ends."""
    decoder, at, out = json.JSONDecoder(), 0, []
    while True:
        while at < len(text) and text[at].isspace():
            at += 1
        if at == len(text):
            return out
        _, end = decoder.raw_decode(text, at)
        out.append(text[at:end])
        at = end


def literal_edits(spark: SparkSession, documents: list[str]) -> DataFrame:
    """Edits given as JSON text, numbered from 0 in ``edit_id``."""
    rows: Column = F.array(*(F.struct(F.lit(i).cast("long").alias("edit_id"), F.lit(d).alias("value")) for i, d in enumerate(documents)))
    return spark.range(1).select(F.inline(rows)).select("edit_id", F.from_json("value", EDIT).alias("e")).select("edit_id", "e.*")


def added(edits: DataFrame) -> DataFrame:
    return edits.select("edit_id", F.explode("new_files").alias("f")).select(
        "edit_id", F.col("f.id").alias("sst_id"), "f.level", "f.size", "f.smallest_key", "f.largest_key")


def removed(edits: DataFrame) -> DataFrame:
    return edits.select("edit_id", F.explode("delete_files").alias("f")).select("edit_id", F.col("f.id").alias("sst_id"), "f.level")


def live(edits: DataFrame, up_to: int | None = None) -> DataFrame:
    """The live files with the edits that added them, after all edits or after edit ``up_to``."""
    if up_to is not None:
        edits = edits.where(F.col("edit_id") <= up_to)
    return added(edits).join(removed(edits).select("sst_id").distinct(), "sst_id", "left_anti")


def replay(edits: DataFrame, up_to: int | None = None) -> DataFrame:
    """The live files (sst_id, level, size, smallest_key, largest_key) after all edits, or after edit ``up_to``."""
    return live(edits, up_to).drop("edit_id")


def counters(edits: DataFrame) -> DataFrame:
    """One row: the highest next_table_id and sequence_number."""
    return edits.agg(F.max("next_table_id").alias("next_table_id"), F.max("sequence_number").alias("sequence_number"))


def versions(edits: DataFrame) -> DataFrame:
    """(version_id, sst_id, level, size, smallest_key, largest_key): the files of the version that each edit makes."""
    ids = edits.select(F.col("edit_id").alias("version_id"))
    gone = removed(edits).select("sst_id", F.col("edit_id").alias("gone"))
    span = added(edits).join(gone, "sst_id", "left")
    return (span.join(ids, (F.col("version_id") >= F.col("edit_id")) & (F.col("gone").isNull() | (F.col("version_id") < F.col("gone"))))
            .select("version_id", "sst_id", "level", "size", "smallest_key", "largest_key"))


def obsolete(edits: DataFrame, retained_from: int) -> DataFrame:
    """(edit_id, sst_id, level) of files that no version from ``retained_from`` on refers to: a file leaves with one edit."""
    gone = removed(edits).groupBy("sst_id").agg(F.min("edit_id").alias("gone"))
    return (added(edits).join(gone, "sst_id").where(F.col("gone") <= F.greatest(F.lit(retained_from), "edit_id"))
            .select("edit_id", "sst_id", "level"))
