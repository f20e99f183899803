"""Scans of tables with a declared schema: what is read is checked, typed and filtered where the files are.

A declaration names the columns that a scan needs with their types and those that may not be null. Files are read with
just these columns; conditions are plain expressions over columns, so Spark pushes them into the Parquet scan. Missing
tables, unreadable files and other columns or types than declared are errors of their own.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.sources.readers import SchemaDriftError


class MissingSourceError(FileNotFoundError):
    """There is nothing at a source's place."""


class MalformedSourceError(ValueError):
    """A source's files can't be read as what they should be."""


@dataclass(frozen=True)
class Declared:
    """Columns as DDL, and those without nulls."""

    ddl: str
    not_null: tuple[str, ...] = ()

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.ddl)


def condition_of(error: AnalysisException) -> str:
    return error.getCondition() or "" if hasattr(error, "getCondition") else error.getErrorClass() or ""


def opened(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table as its files declare it."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if condition_of(error).startswith("PATH_NOT_FOUND"):
            raise MissingSourceError(path) from error
        raise MalformedSourceError(f"{path}: {condition_of(error)}") from error
    except Exception as error:  # the footer of a file that is no Parquet
        raise MalformedSourceError(f"{path}: {type(error).__name__}") from error


def scan(spark: SparkSession, path: str, declared: Declared, where: Column | None = None) -> DataFrame:
    """The declared columns of the rows that meet the condition; rows with a null where none may be are left out, as a
    pushed filter. A column that is absent or of another type is a SchemaDriftError."""
    found = {f.name: f.dataType for f in opened(spark, path).schema}
    wrong = [f"{f.name}: {found[f.name].simpleString() if f.name in found else 'absent'}, declared {f.dataType.simpleString()}" for f in declared.schema if found.get(f.name) != f.dataType]
    if wrong:
        raise SchemaDriftError(f"{path}: " + "; ".join(wrong))
    rows = spark.read.schema(declared.schema).parquet(path)
    conditions = [F.col(c).isNotNull() for c in declared.not_null] + ([] if where is None else [where])
    return rows.where(reduce(lambda a, b: a & b, conditions)) if conditions else rows


def between(column: str, low: object = None, high: object = None) -> Column:
    """A closed range, open where a bound is None."""
    bounds = [F.col(column) >= F.lit(low)] * (low is not None) + [F.col(column) <= F.lit(high)] * (high is not None)
    return reduce(lambda a, b: a & b, bounds, F.lit(True))


def case_of(rules: list[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """The value of the first rule that holds, as CASE does."""
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for condition, value in rules:
        chain = chain.when(condition, F.lit(value))
    return chain.otherwise(F.lit(otherwise))
