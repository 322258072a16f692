"""Table maintenance (H1 to H5) on stored tables: each change writes the files whose key ranges it meets and publishes a new state.

The rows are those of the functions of the same name in ``catalog``, which make whole new states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import KeyedTable
from . import catalog

c = F.col


def upsert(table: KeyedTable, updates: DataFrame, by: list[str], newest: str, keep: list[str] | None = None) -> None:
    """H1. ``by`` holds the table's key."""
    table.change(updates.select(table.key), lambda rows: catalog.upsert(rows, updates, by, newest, keep))


def replace_children(table: KeyedTable, new: DataFrame) -> None:
    """H2: of a table keyed by the parent. Parents of ``new`` lose their rows and get the new ones."""
    table.change(new.select(table.key), lambda rows: catalog.replace_children(rows, table.key, new))


def delete_cascade(parents: KeyedTable, children: list[KeyedTable], gone: DataFrame, nullified: list[KeyedTable] = ()) -> None:
    """H3: parents without the keys in ``gone``, children without their rows; ``nullified`` keep the rows and lose the key, all
    tables having the same one. Children go first, so that a run that is lost and repeated leaves none without a parent."""
    key = parents.key
    ids = gone.select(key).distinct()
    nulls = gone.sparkSession.createDataFrame([(None,)], ids.schema)
    for table in nullified:  # the first file, which has the null keys, is met as well
        table.change(ids.unionByName(nulls), lambda rows: _without_key(rows, ids, key))
    for table in [*children, parents]:
        table.change(ids, lambda rows: rows.join(ids, key, "left_anti").select(*rows.columns), inserts=False)


def _without_key(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    flagged = rows.join(ids.withColumn("_gone", F.lit(True)), key, "left")
    return flagged.withColumn(key, F.when(c("_gone").isNull(), c(key))).select(*rows.columns)


def reset_overrides(table: KeyedTable, track_ids: DataFrame) -> None:
    """H4."""
    table.change(track_ids.select(table.key), lambda rows: catalog.reset_overrides(rows, track_ids), inserts=False)


def update_columns(table: KeyedTable, updates: DataFrame, columns: list[str], replace: bool = False, status: str | None = None) -> None:
    """H5, D10. Rows that the table lacks are not added."""
    table.change(updates.select(table.key), lambda rows: catalog.update_columns(rows, updates, columns, replace, status), inserts=False)
