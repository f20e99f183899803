"""Sources: strict text tables, curated references, tolerant JSON logs, and checks of columns and domains."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SchemaDriftError(ValueError):
    """Columns or values of a source are not those that were agreed on."""


def read_strict_csv(spark: SparkSession, path: str, columns: list[str], null: str = "null") -> DataFrame:
    """An all-string scan with a header: exactly these columns in any order, a null token, UTF-8, malformed rows fail.
    A missing file is a MissingSourceError at once."""
    from terrane.sources.scans import MissingSourceError, condition_of

    try:
        header = spark.read.option("header", True).csv(path).columns
    except AnalysisException as error:
        if condition_of(error).startswith("PATH_NOT_FOUND"):
            raise MissingSourceError(path) from error
        raise
    validate_columns(header, columns)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    return spark.read.schema(schema).option("header", True).option("nullValue", null).option("mode", "FAILFAST").option("encoding", "UTF-8").csv(path).select(*columns)


def validate_columns(found: list[str], expected: list[str]) -> None:
    missing, extra = sorted(set(expected) - set(found)), sorted(set(found) - set(expected))
    if missing or extra:
        raise SchemaDriftError(f"missing columns {missing}, unexpected columns {extra}")


def unexpected_values(df: DataFrame, domains: dict[str, tuple[str, ...]]) -> DataFrame:
    """(column, value, n) of values outside their closed domain, null included, all columns in one pass."""
    bad = [F.when(F.col(c).isNull() | ~F.col(c).isin(*values), F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))) for c, values in domains.items()]
    rows = df.select(F.explode(F.filter(F.array(*bad), lambda x: x.isNotNull())).alias("b")).select("b.*")
    return rows.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def validate_domains(df: DataFrame, domains: dict[str, tuple[str, ...]]) -> None:
    found = unexpected_values(df, domains).limit(20).collect()
    if found:
        raise SchemaDriftError("; ".join(f"{r.column}: {r.value!r} ({r.n} rows)" for r in found))


def blank_to_null(column: Column | str) -> Column:
    return F.nullif(F.trim(column), F.lit(""))


def id_list(column: Column | str, separator: str = ";") -> Column:
    """A separated list as an array of longs; entries that are no number are null."""
    return F.transform(F.split(column, separator), lambda x: F.trim(x).try_cast("long"))


def read_projects(spark: SparkSession, path: str, columns: list[str], dates: list[str], lists: list[str]) -> DataFrame:
    """A curated reference: strict header, trimmed blanks as null, lenient dates beside their raw text, id lists."""
    df = read_strict_csv(spark, path, columns, null="")
    df = df.select(*[blank_to_null(c).alias(c) for c in columns])
    df = df.withColumns({f"{c}_raw": F.col(c) for c in dates}).withColumns({c: F.try_to_date(F.col(c), "yyyy-MM-dd") for c in dates})
    return df.withColumns({c: id_list(c) for c in lists})


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Log lines as columns; lines that are no JSON object are skipped."""
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE"})
    whole = F.col("value").rlike(r"^\s*\{.*\}\s*$")
    return spark.read.text(path).where(whole).select(parsed.alias("r")).where("r is not null").select("r.*")
