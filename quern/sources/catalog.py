"""CATALOG TABLE and DESCRIBE TABLE: external CSV and Parquet files as relations."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quern.errors import CatalogProblem
from quern.session import copy_session
from quern.sql.lower import Relation

YES, NO = ("Y", "YES"), ("N", "NO")
CSV_ONLY = ("HEADER", "SEPARATOR", "COLUMNS")
OPTIONS = ("TYPE", "PATH", *CSV_ONLY, "PARTITIONS", "NROWS", "AVG_ROW_SIZE")
# Types of a COLUMNS list.
COLUMN_TYPES = {"STRING": T.StringType(), "INT": T.LongType()}


#: Lines from which the types of a CSV file are told.
SAMPLE_ROWS = 10_000


@dataclass(frozen=True)
class Table:
    """A registered table."""

    name: str
    kind: str
    path: str
    frame: DataFrame
    view: str
    header: bool = True
    separator: str = ","
    partitions: int = 1
    rows: int = 1
    row_size: int = 1
    options: dict = field(default_factory=dict, compare=False)


def declared_schema(columns: str) -> T.StructType:
    """The schema of ``a=STRING,b=INT``, names in capitals."""
    fields = []
    for part in columns.split(","):
        name, _, kind = (x.strip() for x in part.partition("="))
        if not name or kind.upper() not in COLUMN_TYPES:
            raise CatalogProblem(f"COLUMNS has {part.strip()!r}; it needs NAME=STRING or NAME=INT")
        fields.append(T.StructField(name.upper(), COLUMN_TYPES[kind.upper()]))
    return T.StructType(fields)


class Catalog:
    """The tables of one job. Names are in capitals and can be used once."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, {}
        self._prefix = "quern_" + uuid.uuid4().hex[:8]

    def create(self, name: str, options: Iterable[tuple[str, str | int]]) -> Table:
        """Register a file or folder under ``name``."""
        name = name.upper()
        if name in self.tables:
            raise CatalogProblem(f"table {name} is already there")
        given: dict[str, str | int] = {}
        for key, value in options:
            if key not in OPTIONS:
                raise CatalogProblem(f"unknown option {key}")
            if key in given:
                raise CatalogProblem(f"option {key} is given twice")
            given[key] = value
        kind = str(given.get("TYPE", "")).upper()
        if kind not in ("CSV", "PARQUET"):
            raise CatalogProblem("TYPE must be CSV or PARQUET")
        path = given.get("PATH")
        if not isinstance(path, str) or not path:
            raise CatalogProblem("PATH must be a string")
        if kind == "PARQUET" and (wrong := [k for k in CSV_ONLY if k in given]):
            raise CatalogProblem(f"{', '.join(wrong)} can't go with Parquet")
        header = self._yes_no(given.get("HEADER", "YES"))
        separator = str(given.get("SEPARATOR", ","))
        if len(separator) != 1:
            raise CatalogProblem("SEPARATOR must be one character")
        counts = {k: self._count(k, given.get(k, 1)) for k in ("PARTITIONS", "NROWS", "AVG_ROW_SIZE")}
        reader = self._reader(counts["PARTITIONS"])
        frame = self._csv(reader, path, header, separator, given.get("COLUMNS")) if kind == "CSV" else reader.read.parquet(path)
        if reader is not self.spark:
            shared = f"{self._prefix}_{name}_scan".replace("-", "_")
            frame.createOrReplaceGlobalTempView(shared)
            frame = self.spark.table(f"global_temp.`{shared}`")
        return self._register(Table(name, kind, path, frame, f"{self._prefix}_{name}", header, separator, counts["PARTITIONS"], counts["NROWS"], counts["AVG_ROW_SIZE"], given))

    def _reader(self, partitions: int) -> SparkSession:
        """The session that reads a table. PARTITIONS is met by smaller splits, never by a shuffle; how
        a file is split belongs to the session that reads it, so such a table gets one of its own."""
        if partitions == 1:
            return self.spark
        reader = copy_session(self.spark)
        reader.conf.set("spark.sql.files.minPartitionNum", str(partitions))
        reader.conf.set("spark.sql.files.openCostInBytes", "1")
        return reader

    def add_frame(self, name: str, frame: DataFrame) -> Table:
        """Register any DataFrame, for use from Python."""
        name = name.upper()
        if name in self.tables:
            raise CatalogProblem(f"table {name} is already there")
        return self._register(Table(name, "QUERY", "", frame, f"{self._prefix}_{name}"))

    def _register(self, table: Table) -> Table:
        table.frame.createOrReplaceTempView(table.view)
        self.tables[table.name] = table
        return table

    def get(self, name: str) -> Table:
        try:
            return self.tables[name.upper()]
        except KeyError:
            raise CatalogProblem(f"unknown table {name}") from None

    def relations(self) -> dict[str, Relation]:
        """What the lowering needs to know of the tables."""
        return {n: Relation(f"`{t.view}`", frozenset(c.upper() for c in t.frame.columns)) for n, t in self.tables.items()}

    def describe(self, name: str) -> DataFrame:
        """``item``, ``value`` rows: path, options, statistics, then columns and types."""
        t = self.get(name)
        rows = [("TABLE", t.name), ("TYPE", t.kind), ("PATH", t.path)]
        if t.kind == "CSV":
            rows += [("HEADER", "YES" if t.header else "NO"), ("SEPARATOR", t.separator)]
        rows += [("PARTITIONS", str(t.partitions)), ("NROWS", str(t.rows)), ("AVG_ROW_SIZE", str(t.row_size))]
        rows += [(f"COLUMN {f.name.upper()}", f.dataType.simpleString()) for f in t.frame.schema.fields]
        return self.spark.createDataFrame(rows, "item string, value string")

    def _csv(self, session: SparkSession, path: str, header: bool, separator: str, columns: str | int | None) -> DataFrame:
        """Columns as declared, or as the first SAMPLE_ROWS lines have them: types are told without
        reading all of the file. A value further down that isn't of its column's type is an error, not a null."""
        reader = session.read.option("header", header).option("sep", separator)
        if columns is not None:
            return reader.schema(declared_schema(str(columns))).option("enforceSchema", True).csv(path)
        lines = [r[0] for r in session.read.text(path).limit(SAMPLE_ROWS + 1).collect()]
        if not lines:
            raise CatalogProblem(f"{path} is empty, so it needs COLUMNS")
        told = reader.option("inferSchema", True).csv(session.sparkContext.parallelize(lines, 1)).schema
        names = reader.csv(path).columns
        # whole numbers are 64 bits wide, names are in capitals
        fields = [T.StructField(n, T.LongType() if isinstance(f.dataType, T.IntegerType) else f.dataType) for n, f in zip(names, told.fields)]
        mode = "PERMISSIVE" if len(lines) <= SAMPLE_ROWS else "FAILFAST"
        found = reader.schema(T.StructType(fields)).option("mode", mode).csv(path)
        return found.toDF(*[n.upper() for n in names])

    @staticmethod
    def _yes_no(value: str | int) -> bool:
        if value in YES:
            return True
        if value in NO:
            return False
        raise CatalogProblem("HEADER must be Y, YES, N or NO")

    @staticmethod
    def _count(key: str, value: str | int) -> int:
        if not isinstance(value, int) or value < 1:
            raise CatalogProblem(f"{key} must be a positive number")
        return value
