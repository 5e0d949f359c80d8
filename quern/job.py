"""Running scripts: the statements of a job in order."""

from __future__ import annotations

import logging
from collections.abc import Iterable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from quern.errors import QueryProblem, SettingProblem
from quern.plans.explain import plan_dot, plan_text, syntax_dot
from quern.session import copy_session
from quern.sources.catalog import Catalog
from quern.sql import syntax as S
from quern.sql.lower import Lowering
from quern.sql.parser import parse_script

log = logging.getLogger("quern")

TRUE_WORDS = ("TRUE", "T", "YES", "Y")
# Levels of a trace filter, and what the cluster logs at them.
LEVELS = {"error": "ERROR", "warn": "WARN", "info": "INFO", "debug": "DEBUG", "trace": "TRACE", "off": "OFF"}


@dataclass(frozen=True)
class Result:
    """What a statement gives: a DataFrame, unless the job only parses."""

    statement: S.Statement
    frame: DataFrame | None = None
    sql: str | None = None

    def explain(self, mode: str = "formatted") -> str:
        return plan_text(self.frame, mode) if self.frame is not None else self.sql or ""

    def dot(self, stage: str = "syntax") -> str:
        """The graph of a query in the DOT language: its ``syntax``, its ``resolved``, ``logical`` (optimised) or ``physical`` plan."""
        if not isinstance(self.statement, S.Query):
            raise QueryProblem("only queries have a graph")
        if stage == "syntax":
            return syntax_dot(self.statement)
        if self.frame is None:
            raise QueryProblem("a query that is only parsed has no plan")
        return plan_dot(self.frame, stage)


class Job:
    """State of a script: its tables and settings."""

    def __init__(self, spark: SparkSession):
        self.spark, self.catalog = spark, Catalog(spark)
        self.parse_only = False

    def run(self, text: str) -> list[Result]:
        """All statements; lazily, as far as Spark is."""
        statements = parse_script(text)
        traces = [s for s in statements if isinstance(s, S.SetOption) and s.name == "TRACE"]
        if len(traces) > 1:
            raise SettingProblem("TRACE can be set once")
        for s in traces:  # before everything else
            self._trace(s.value)
        return [self._statement(s) for s in statements if s not in traces]

    def query(self, text: str) -> DataFrame:
        """The result of the last query in ``text``."""
        frames = [r.frame for r in self.run(text) if isinstance(r.statement, S.Query) and r.frame is not None]
        if not frames:
            raise QueryProblem("no query was run")
        return frames[-1]

    def _statement(self, s: S.Statement) -> Result:
        match s:
            case S.CatalogTable(name, options):
                self.catalog.create(name, options)
                return Result(s)
            case S.DescribeTable(name):
                return Result(s, self.catalog.describe(name))
            case S.SetOption():
                self._set(s)
                return Result(s)
        sql = Lowering(self.catalog.relations()).query(s)
        log.debug("lowered: %s", sql)
        frame = self.spark.sql(sql)
        return Result(s, None if self.parse_only else frame, sql)

    def _set(self, s: S.SetOption) -> None:
        if s.name == "PARALLEL_DEGREE":
            if not isinstance(s.value, int) or s.value < 1:
                raise SettingProblem("PARALLEL_DEGREE must be a positive number")
            # in a session of this job, so that others keep theirs
            self.spark = self.catalog.spark = copy_session(self.spark)
            self.spark.conf.set("spark.sql.shuffle.partitions", str(s.value))
        elif s.name == "PARSE_ONLY":
            if not isinstance(s.value, str):
                raise SettingProblem("PARSE_ONLY must be a string")
            self.parse_only = s.value.upper() in TRUE_WORDS
        else:
            raise SettingProblem(f"unknown setting {s.name}")

    def _trace(self, value: str | int) -> None:
        if not isinstance(value, str):
            raise SettingProblem("TRACE must be a string")
        # the first part is the level of all; parts such as [plan]=debug deepen ours
        first, *parts = value.split(",")
        level = first.strip().lower()
        if level in LEVELS:
            self.spark.sparkContext.setLogLevel("ERROR" if LEVELS[level] == "INFO" else LEVELS[level])
        deepest = "debug" if any(p.strip().endswith(("=debug", "=trace")) for p in [first, *parts]) else level
        log.setLevel({"off": logging.CRITICAL, "trace": logging.DEBUG}.get(deepest, getattr(logging, LEVELS.get(deepest, "INFO"))))


def run_script(spark: SparkSession, text: str) -> list[Result]:
    """Run a script in a new job."""
    return Job(spark).run(text)


def write_result(frame: DataFrame, folder: str) -> None:
    """One headerless CSV file per partition."""
    distinct = [f"c{i}" for i in range(len(frame.columns))]
    frame.toDF(*distinct).write.mode("overwrite").option("header", False).csv(folder)


def main(args: Iterable[str]) -> int:
    """``python -m quern SCRIPT [FOLDER]``: run a script, show ten rows a result, write results."""
    args = list(args)
    if not 1 <= len(args) <= 2:
        print(main.__doc__)
        return 2
    from quern.errors import ScriptError
    from quern.session import local_session

    spark = SparkSession.getActiveSession() or local_session()
    try:
        results = run_script(spark, Path(args[0]).read_text())
    except ScriptError as e:
        print(f"error: {e}")
        return 1
    number = 0
    for r in results:
        if r.frame is None:
            continue
        r.frame.show(10 if isinstance(r.statement, S.Query) else 1000, truncate=False)
        if isinstance(r.statement, S.Query) and len(args) == 2:
            write_result(r.frame, f"{args[1]}/query-{number}")
            number += 1
    return 0
