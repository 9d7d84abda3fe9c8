"""Paged scan of many remote tables as a Python data source.

A table is one partition: its pages can only be read one after the other, as each names the next. Tables are read in
parallel; a filter on table_name that Spark pushes down leaves the others alone. What a table's pages come from is a client with
tables() and page(table, size, token); LinePages reads folders of JSON lines in a shared store.

A table that can't be read, or that is asked for and isn't there, gives one row with its error; scan() then takes none of its rows.
Records without fields are passed over.
"""

from __future__ import annotations

import io
import json
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from .shared import cut

# The source travels with the job, so executors need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PAGE_SIZE = 100
SCHEMA = "table_name string, seq long, record_json string, error string"


class LinePages:
    """Tables as folders of line files, {"fields": {..}} a line. A token is a file's place and the offset in it."""

    def __init__(self, root: str):
        self.root = root

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root)

    def _listed(self, path: str, store) -> list:
        from pyarrow import fs

        found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return sorted((x for x in found if x.base_name[:1] not in "._"), key=lambda x: x.base_name)

    def tables(self) -> list[str]:
        from pyarrow import fs

        store, path = self._store()
        return [x.base_name for x in self._listed(path, store) if x.type == fs.FileType.Directory]

    def page(self, table: str, size: int, token: str | None) -> tuple[list[dict], str | None]:
        """At most size items from the token on, and the token of the next page, if there is more."""
        store, path = self._store()
        listed = self._listed(f"{path}/{table}", store)
        if not listed:
            raise FileNotFoundError(f"no table {table}")
        place, offset = map(int, token.split(":")) if token else (0, 0)
        items: list[dict] = []
        while place < len(listed):
            with io.BufferedReader(store.open_input_file(listed[place].path)) as f:
                f.seek(offset)
                while len(items) < size and (line := f.readline()):
                    items.append(json.loads(line))
                offset = f.tell()
            if offset < listed[place].size:
                return items, f"{place}:{offset}"
            place, offset = place + 1, 0
            if len(items) >= size and any(x.size for x in listed[place:]):
                return items, f"{place}:0"
        return items, None


@dataclass
class TablePartition(InputPartition):
    table: str


class PageReader(DataSourceReader):
    def __init__(self, client, size: int, names: Sequence[str] | None):
        self.client, self.size = client, size
        self.names = None if names is None else set(names)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Names of tables; everything else is left to Spark."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("table_name",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = wanted if self.names is None else self.names & wanted
            else:
                yield f

    def partitions(self) -> list[TablePartition]:
        return [TablePartition(t) for t in (self.client.tables() if self.names is None else sorted(self.names))]

    def read(self, partition: TablePartition | None) -> Iterator[tuple]:
        if partition is None:  # Spark's only partition of a source that has none
            return
        token, seq = None, 0
        try:
            while True:
                items, token = self.client.page(partition.table, self.size, token)
                for item in items:
                    if item.get("fields"):
                        seq += 1
                        yield partition.table, seq, json.dumps(item["fields"], ensure_ascii=False), None
                if not token:
                    return
        except Exception as e:  # whatever a remote table's reading meets, the other tables go on
            yield partition.table, None, None, f"{type(e).__name__}: {e}"


class Pages(DataSource):
    """Options: path (of a line store), page_size, tables (a JSON list; all by default)."""

    @classmethod
    def name(cls) -> str:
        return "claimforge_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        names = self.options.get("tables")
        return PageReader(LinePages(self.options["path"]), int(self.options.get("page_size", PAGE_SIZE)), json.loads(names) if names else None)


def raw_scan(spark: SparkSession, path: str, size: int = PAGE_SIZE) -> DataFrame:
    """SCHEMA of every table, a filter on table_name pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Pages)
    return spark.read.format("claimforge_pages").option("path", path).option("page_size", size).load()


def scan(spark: SparkSession, path: str, names: Sequence[str] | None = None, size: int = PAGE_SIZE) -> tuple[DataFrame, DataFrame]:
    """Records (table_name, seq, record_json) of the tables that could be read whole, and errors (table_name, error) of the others.

    The scan is kept in the shared folder: the remote tables are read once, whatever is done with the rows."""
    raw = raw_scan(spark, path, size)
    kept = cut(raw if names is None else raw.filter(F.col("table_name").isin(list(names))))
    errors = kept.filter("error is not null").select("table_name", "error")
    return kept.filter("error is null").join(errors, "table_name", "left_anti").select("table_name", "seq", "record_json"), errors


def store_lines(df: DataFrame, path: str, table: str) -> None:
    """A table as a folder that LinePages reads."""
    df.select(F.to_json(F.struct(F.struct(*df.columns).alias("fields"))).alias("value")).write.text(f"{path}/{table}")
