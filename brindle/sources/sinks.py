"""Sinks: upserts, cascading deletes and reports, as tables rewritten whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.relational import latest


def upserted(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """stored with new rows in the place of those of equal keys; the last of several new ones wins (column version)."""
    fresh = latest(new, key, F.col("version"))
    return stored.join(fresh.select(key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """df without the rows of some keys, as a delete writes it."""
    return df.join(gone.select(key), key, "left_anti")


def cascade(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table without the rows of the keys that are gone."""
    return {name: without(df, gone, key) for name, df in tables.items()}


def delete_files(stores: dict[str, DataFrame], edges: DataFrame, vertices: DataFrame, gone: DataFrame, key: str = "file_id") -> dict[str, DataFrame]:
    """Every store (chunks, postings, tables, states ...) and the graph without some files: rows of the files go, edges of theirs, and
    vertices that no edge holds any more. The tables to write in the place of the old ones, by name."""
    from brindle.operators.graph import without_file

    e, v = without_file(edges, vertices, gone)
    return {**cascade(stores, gone, key), "edges": e, "vertices": v}


def cloned(chunks: DataFrame, clones: DataFrame) -> DataFrame:
    """Chunks of files that are copied under new ids: clones has file_id and new_file_id (files of an equal content hash); texts
    and vectors are taken over, ids are made anew from the new file and the place."""
    from brindle.functions.identity import chunk_id

    d = chunks.join(clones.select("file_id", "new_file_id"), "file_id").withColumn("file_id", F.col("new_file_id")).drop("new_file_id")
    return d.withColumn("chunk_id", chunk_id(F.col("file_id"), F.col("chunk_index")))


def merged_daily(stored: DataFrame, new: DataFrame, day: str = "day") -> DataFrame:
    """Daily reports: a day of the new ones replaces the stored one."""
    return stored.join(new.select(day), day, "left_anti").unionByName(new)


def write_partitioned(df: DataFrame, path: str, by: str, mode: str = "overwrite") -> None:
    """Write by partitions; an overwrite replaces only the partitions that df holds."""
    df.repartition(by).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def tab_separated(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", "true").csv(path)


def key_values(columns: list[str], digits: int = 10) -> Column:
    """`name=value, ...` of a row, nulls left out."""
    return F.concat_ws(", ", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in columns])
