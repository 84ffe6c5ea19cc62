"""Versioned Parquet tables with all-or-nothing commits.

Data go to new folders first; one row appended to the commit log then names the folders of
every table. A reader sees the last commit, so a failed write changes nothing and an older
commit is a snapshot. One writer at a time, as with the single database file before.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_LOG = ("commit_id long, tables map<string, struct<folders: array<string>, schema: string>>, "
        "note string")


class Staged(NamedTuple):
    """Rows in a new folder that no commit names yet; columns outside the schema are not read from it."""
    folder: str
    schema: StructType


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # --- the log ---
    def history(self) -> DataFrame:
        try:
            return self.spark.read.schema(_LOG).json(f"{self.root}/_commits")
        except AnalysisException:
            return self.spark.createDataFrame([], _LOG)

    def _state(self, commit_id: int | None = None) -> tuple[int, dict]:
        log = self.history()
        if commit_id is not None:
            log = log.where(F.col("commit_id") == commit_id)
        row = log.orderBy(F.desc("commit_id")).limit(1).collect()
        if not row:
            return 0, {}
        return row[0].commit_id, {t: (e.folders, e.schema) for t, e in row[0].tables.items()}

    def committed(self, note: str) -> bool:
        return not self.history().where(F.col("note") == note).isEmpty()

    def _log(self, last: int, tables: dict, note: str) -> int:
        row = [(last + 1, tables, note)]
        self.spark.createDataFrame(row, _LOG).coalesce(1).write.mode("append").json(
            f"{self.root}/_commits")
        return last + 1

    # --- tables ---
    def exists(self, table: str) -> bool:
        return table in self._state()[1]

    def read(self, table: str, commit_id: int | None = None) -> DataFrame:
        """A table by the schema in the log, so no file footers are read to find it."""
        folders, schema = self._state(commit_id)[1][table]
        return self.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(*folders)

    def stage(self, table: str, df: DataFrame, schema: StructType | None = None) -> Staged:
        """Write rows for a later commit, so that they can be read before it; with ``schema`` only these columns count."""
        folder = f"{self.root}/{table}/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        return Staged(folder, schema or df.schema)

    def commit(self, replace: dict | None = None, append: dict | None = None, note: str = "") -> int:
        """Write all frames that are not staged yet, then switch to them together."""
        staged = [(t, df if isinstance(df, Staged) else self.stage(t, df), whole)
                  for frames, whole in ((replace, True), (append, False)) for t, df in (frames or {}).items()]
        last, tables = self._state()
        for table, (folder, schema), whole in staged:
            if whole or table not in tables:
                folders = [folder]
            else:       # older columns first, then those the append adds
                folders = [*tables[table][0], folder]
                older = StructType.fromJson(json.loads(tables[table][1]))
                schema = StructType(older.fields + [f for f in schema if f.name not in older.names])
            tables[table] = (folders, schema.json())
        return self._log(last, tables, note)

    def compact(self, table: str) -> int:
        """Rewrite the folders of many appends as one."""
        return self.commit(replace={table: self.read(table)}, note=f"compact {table}")

    def restore(self, commit_id: int) -> int:
        """Make an older commit the current one."""
        _, tables = self._state(commit_id)
        return self._log(self._state()[0], tables, f"restore {commit_id}")

    def export(self, path: str) -> None:
        """Copy the current tables to a backup folder."""
        for table in self._state()[1]:
            self.read(table).write.mode("overwrite").parquet(f"{path}/{table}")

    def load_backup(self, path: str, tables) -> int:
        """Take a backup's tables as the current ones."""
        return self.commit(replace={t: self.spark.read.parquet(f"{path}/{t}") for t in tables},
                           note="backup loaded")

    # --- gold tables ---
    def materialise(self, name: str, df: DataFrame) -> DataFrame:
        self.commit(replace={name: df}, note=f"gold {name}")
        return self.read(name)

    def read_or_compute(self, name: str, compute, refresh: bool = False) -> DataFrame:
        """The stored gold table; computed and stored when missing or on request."""
        return self.read(name) if self.exists(name) and not refresh else self.materialise(name, compute())
