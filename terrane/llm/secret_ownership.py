"""Secret scans with corpus-wide ownership frequency.

Candidates come from fixed patterns. Their values are hashed, and each hash is counted over the distinct repositories
and owners that hold it. A value of many owners or of many repositories is a widely copied `example`; a value of a
single owner and few repositories that looks like a generated one is `live`; one that looks so and has some owners
more, but too few for an example, is `shared`. Counts are pre-aggregated by value, owner and repository, so a value
that a third of all documents hold stays cheap.

A value looks generated if its characters carry enough bits each, at least two of lower case, upper case and digits
occur, and it spells no placeholder.

DataFrame functions only. Defined results: a null text is empty and has no span. A null owner or repository is an owner
or repository of its own. Repeated rows are judged alike and do not add owners. An empty table gives an empty result.
Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import attached
from terrane.llm.spans import Kind, base_spans
from terrane.session import cut

#: Fixed patterns of the base candidates.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
KINDS = (
    Kind("assign", ASSIGN, lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 1)) >= 6, lambda m: F.regexp_extract(m, ASSIGN, 1)),
    Kind("access", r"AKIA[A-Z0-9]{16,}+"),
    Kind("hex", r"[0-9a-f]{24,}+"),
)
#: Owners, or repositories, from which on a value is an example; bits a character of one that looks generated.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES, LIVE_BITS = 3, 4, 2.75
#: Fixed parts of placeholders.
PLACEHOLDER = "(?i)example|sample|changeme|placeholder|dummy|your|test|xxxx|1234|abcd"


def entropy(value: Column) -> Column:
    """Shannon's bits for each character of the value."""
    n = F.char_length(value).cast("double")
    share = lambda c: (n - F.char_length(F.replace(value, c, F.lit("")))) / n
    return F.aggregate(F.array_distinct(F.filter(F.split(value, ""), lambda c: c != "")), F.lit(0.0), lambda bits, c: bits - share(c) * F.log2(share(c)))


def generated(value: Column) -> Column:
    classes = F.lit(0)
    for pattern in ("[a-z]", "[A-Z]", "[0-9]"):
        classes = classes + F.regexp_like(value, F.lit(pattern)).cast("int")
    return (entropy(value) >= LIVE_BITS) & (classes >= 2) & ~F.regexp_like(value, F.lit(PLACEHOLDER))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """One row per document: id, base (spans) and marks (spans `example`, `shared` and `live` of values, by ownership)."""
    owner = F.col("source") if owner is None else owner
    repository = F.struct("source", "lang") if repository is None else repository
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), owner.cast("string").alias("owner"), F.to_json(F.struct(repository.alias("r"))).alias("repository"), base_spans(text, KINDS).alias("base"), F.monotonically_increasing_id().alias("row"))
    rows = cut(rows, "candidates")
    held = rows.select("row", "owner", "repository", F.explode("base").alias("span")).withColumn("h", F.sha2("span.value", 256))
    by_repository = held.groupBy("h", "owner", "repository").agg(F.count(F.lit(1)).alias("n"), F.max(generated(F.col("span.value"))).alias("generated"))
    by_owner = by_repository.groupBy("h", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("n").alias("n"), F.max("generated").alias("generated"))
    owned = by_owner.groupBy("h").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("n"), F.max("generated").alias("generated"))
    copied = (F.col("owners") >= EXAMPLE_OWNERS) | (F.col("repositories") >= EXAMPLE_REPOSITORIES)
    verdict = F.when(copied, "example").when(F.col("generated"), F.when(F.col("owners") == 1, "live").otherwise("shared"))
    verdicts = cut(owned.select("h", "n", verdict.alias("verdict")).where("verdict is not null"), "verdicts")
    judged = attached(held.select("row", "span", "h"), verdicts, ["h"], "n").where("verdict is not null")
    start = F.col("span.end") - F.char_length("span.value")
    mark = F.struct(start.alias("start"), F.lit(len(KINDS)).alias("rank"), F.col("span.end").alias("end"), F.col("verdict").alias("kind"), F.col("span.value").alias("value"))
    marks = judged.groupBy("row").agg(F.array_sort(F.collect_set(mark)).alias("marks"))
    out = rows.join(marks, "row", "left")
    return out.select(F.col("id").alias(id_col), "base", F.coalesce("marks", F.array().cast(rows.schema["base"].dataType)).alias("marks"))
