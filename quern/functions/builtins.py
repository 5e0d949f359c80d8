"""Names of types and functions of the dialect in Spark SQL."""

from __future__ import annotations

from quern.errors import QueryProblem

# Type names of CAST and of column lists, and their Spark types.
TYPES = {
    "INT8": "TINYINT",
    "INT16": "SMALLINT",
    "INT32": "INT",
    "INT64": "BIGINT",
    "UINT8": "SMALLINT",
    "UINT16": "INT",
    "UINT32": "BIGINT",
    "UINT64": "DECIMAL(20,0)",
    "FLOAT16": "FLOAT",
    "FLOAT32": "FLOAT",
    "FLOAT64": "DOUBLE",
    "DATE32": "DATE",
    "DATE64": "TIMESTAMP_NTZ",
    "UTF8": "STRING",
    "STRING": "STRING",
    "VARCHAR": "STRING",
    "BOOLEAN": "BOOLEAN",
    "INT": "BIGINT",
    "INTEGER": "BIGINT",
    "BIGINT": "BIGINT",
    "DOUBLE": "DOUBLE",
    "FLOAT": "DOUBLE",
    "DATE": "DATE",
    "DATETIME": "TIMESTAMP_NTZ",
    "TIMESTAMP": "TIMESTAMP_NTZ",
}

# Units of DATEADD and DATEPART by their names and abbreviations.
UNITS = {
    unit: full
    for full, units in {
        "YEAR": "YEAR YY YYYY",
        "QUARTER": "QUARTER QQ Q",
        "MONTH": "MONTH MM M",
        "WEEK": "WEEK WK WW",
        "DAY": "DAY DD D",
        "HOUR": "HOUR HH",
        "MINUTE": "MINUTE MI N",
        "SECOND": "SECOND SS S",
    }.items()
    for unit in units.split()
}


def spark_type(name: str) -> str:
    """The Spark type of a type name."""
    try:
        return TYPES[name.upper()]
    except KeyError:
        raise QueryProblem(f"unknown type {name}") from None


def date_unit(name: str) -> str:
    """The full name of a date unit."""
    try:
        return UNITS[name.upper()]
    except KeyError:
        raise QueryProblem(f"unknown date unit {name}") from None
