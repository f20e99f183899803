"""Queries on drift, logs, folds, gates and name resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.operators import drift, folds
from terrane.operators import timeseries as ts
from terrane.plans.catalogue import query
from terrane.session import table


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_quantity", "l_returnflag", "l_suppkey", F.year("l_shipdate").alias("y"))
    return lines.where("y <= 1997"), lines.where("y >= 1999")


_S = "l AS (SELECT l_extendedprice, l_returnflag, l_suppkey, year(l_shipdate) <= 1997 AS ref FROM lineitem WHERE year(l_shipdate) <= 1997 OR year(l_shipdate) >= 1999)"


@query(f"""WITH {_S}, e AS (SELECT list_distinct(quantile_cont(l_extendedprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edges FROM l WHERE ref), b AS (SELECT len(list_filter(edges, lambda q: q <= l_extendedprice)) AS bin, ref FROM l, e),
c AS (SELECT bin, greatest(count(*) FILTER (ref) / sum(count(*) FILTER (ref)) OVER (), 0.0001) AS r, greatest(count(*) FILTER (NOT ref) / sum(count(*) FILTER (NOT ref)) OVER (), 0.0001) AS c FROM b GROUP BY bin)
SELECT round(sum((c - r) * ln(c / r)), 6) AS psi FROM c""")
def an40_psi_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, cur = _sides(spark, sf_dir)
    return drift.psi_numeric(ref, cur, "l_extendedprice").select(F.round("psi", 6).alias("psi"))


@query(f"""WITH {_S}, n AS (SELECT l_suppkey AS v, count(*) FILTER (ref) AS r, count(*) FILTER (NOT ref) AS c FROM l GROUP BY 1), k AS (SELECT v FROM n WHERE r > 0 ORDER BY r DESC, CAST(v AS VARCHAR) LIMIT 20),
g AS (SELECT CASE WHEN k.v IS NULL THEN '<other>' ELSE CAST(n.v AS VARCHAR) END AS w, sum(r) AS r, sum(c) AS c FROM n LEFT JOIN k USING (v) GROUP BY 1), s AS (SELECT greatest(r / sum(r) OVER (), 0.0001) AS r, greatest(c / sum(c) OVER (), 0.0001) AS c FROM g)
SELECT round(sum((c - r) * ln(c / r)), 6) AS psi FROM s""")
def an41_psi_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, cur = _sides(spark, sf_dir)
    return drift.psi_categorical(ref, cur, "l_suppkey", 20).select(F.round("psi", 6).alias("psi"))


@query(f"""WITH {_S}, x AS (SELECT l_extendedprice AS v, count(*) FILTER (ref) AS r, count(*) FILTER (NOT ref) AS c FROM l GROUP BY 1)
SELECT round(max(g), 8) AS ks FROM (SELECT abs(sum(r) OVER w / sum(r) OVER () - sum(c) OVER w / sum(c) OVER ()) AS g FROM x WINDOW w AS (ORDER BY v ROWS UNBOUNDED PRECEDING))""")
def an42_ks_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, cur = _sides(spark, sf_dir)
    return drift.ks(ref, cur, "l_extendedprice").select(F.round("ks", 8).alias("ks"))


def _drift_sql(columns: list[str]) -> str:
    rows = []
    for c in columns:
        rows.append(f"""SELECT '{c}' AS feature, (WITH e AS (SELECT list_distinct(quantile_cont({c}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edges FROM l WHERE ref), b AS (SELECT len(list_filter(edges, lambda q: q <= {c})) AS bin, ref FROM l, e),
c AS (SELECT greatest(count(*) FILTER (ref) / sum(count(*) FILTER (ref)) OVER (), 0.0001) AS r, greatest(count(*) FILTER (NOT ref) / sum(count(*) FILTER (NOT ref)) OVER (), 0.0001) AS c FROM b GROUP BY bin) SELECT round(sum((c - r) * ln(c / r)), 6) FROM c) AS psi,
(WITH x AS (SELECT {c} AS v, count(*) FILTER (ref) AS r, count(*) FILTER (NOT ref) AS c FROM l GROUP BY 1) SELECT round(max(g), 8) FROM (SELECT abs(sum(r) OVER w / sum(r) OVER () - sum(c) OVER w / sum(c) OVER ()) AS g FROM x WINDOW w AS (ORDER BY v ROWS UNBOUNDED PRECEDING))) AS ks""")
    return " UNION ALL ".join(rows)


@query(f"""WITH l AS (SELECT l_extendedprice, l_quantity, l_returnflag, year(l_shipdate) <= 1997 AS ref FROM lineitem WHERE year(l_shipdate) <= 1997 OR year(l_shipdate) >= 1999),
d AS ({_drift_sql(["l_extendedprice", "l_quantity"])} UNION ALL SELECT 'l_returnflag', (WITH s AS (SELECT greatest(count(*) FILTER (ref) / sum(count(*) FILTER (ref)) OVER (), 0.0001) AS r, greatest(count(*) FILTER (NOT ref) / sum(count(*) FILTER (NOT ref)) OVER (), 0.0001) AS c FROM l GROUP BY l_returnflag) SELECT round(sum((c - r) * ln(c / r)), 6) FROM s), NULL)
SELECT feature, psi, ks, psi >= 0.2 AS flagged FROM d""")
def an43_drift_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per column: psi, ks where numeric, and a flag from 0.2 on."""
    ref, cur = _sides(spark, sf_dir)
    none = F.lit(None).cast("double").alias("ks")
    parts = [drift.psi_numeric(ref, cur, c).join(F.broadcast(drift.ks(ref, cur, c))).select(F.lit(c).alias("feature"), F.round("psi", 6).alias("psi"), F.round("ks", 8).alias("ks")) for c in ("l_extendedprice", "l_quantity")]
    parts += [drift.psi_categorical(ref, cur, c).select(F.lit(c).alias("feature"), F.round("psi", 6).alias("psi"), none) for c in ("l_returnflag",)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("flagged", F.col("psi") >= 0.2)


@query("""SELECT event_type, hour(ts) AS hour, count(*) AS n, count(DISTINCT user_id) AS users, CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DOUBLE) / count(value) AS mean, count(*) FILTER (CAST(props->>'k' AS INTEGER) > 5) AS n_large FROM events GROUP BY 1, 2""")
def an44_event_log_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    rows = table(spark, sf_dir, "events").select("event_type", F.hour("ts").cast("long").alias("hour"), "user_id", "value", k.alias("k"))
    return rows.groupBy("event_type", "hour").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), (F.sum(F.col("value").cast("decimal(18,4)")).cast("double") / F.count("value")).alias("mean"), F.count_if(F.col("k") > 5).alias("n_large"))


@query("""SELECT event_type, le, count(*) FILTER (value <= le) AS n FROM events, (VALUES (1.0::DOUBLE), (5.0), (10.0), (25.0), (50.0), (100.0), (1000.0)) b(le) GROUP BY 1, 2""")
def st2_latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.histogram(table(spark, sf_dir, "events"), ["event_type"], F.col("value"), [1, 5, 10, 25, 50, 100, 1000])


_DAYS = "o AS (SELECT CAST(CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS INTEGER) AS day FROM orders), m AS (SELECT max(day) AS last FROM o), f AS (SELECT 3 - i AS fold, last - i * 90 - 89 AS start, last - i * 90 AS stop FROM m, range(0, 4) t(i))"


@query(f"""WITH {_DAYS}, r AS (SELECT fold, CASE WHEN day BETWEEN start AND stop THEN 'test' WHEN day + 107 < start THEN 'train' WHEN day < start THEN 'gap' END AS role FROM o, f)
SELECT CAST(fold AS INTEGER) AS fold, role, count(*) AS n FROM r WHERE role IS NOT NULL GROUP BY 1, 2""")
def an13_walk_forward_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(ts.day_number("o_orderdate").alias("day"))
    last = rows.agg(F.max("day")).first()[0] or 0
    out = folds.roles(rows, folds.fold_table(spark, last, 90, 4, 90), "day", 107)
    return out.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH m AS (SELECT o_orderpriority AS model, round(avg(CASE WHEN o_totalprice < 150000 THEN 1.0 ELSE 0.0 END), 6) AS share, count(*) AS n FROM orders GROUP BY 1), x AS (SELECT *, list_filter([CASE WHEN NOT n >= 3000 THEN 'too few rows' END, CASE WHEN NOT share > 0.3 THEN 'share too low' END], lambda r: r IS NOT NULL) AS reasons FROM m)
SELECT model, share, n, array_to_string(reasons, ';') AS reasons, len(reasons) = 0 AS passed FROM x""")
def an16_an51_acceptance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("model")).agg(F.round(F.avg((F.col("o_totalprice") < 150000).cast("double")), 6).alias("share"), F.count(F.lit(1)).alias("n"))
    out = folds.gate(metrics, [("too few rows", F.col("n") >= 3000), ("share too low", F.col("share") > 0.3)])
    return out.select("model", "share", "n", F.array_join("reasons", ";").alias("reasons"), "passed")


@query("""WITH a AS (SELECT p_brand AS alias, count(DISTINCT p_size) AS k, min(p_size) AS t FROM part GROUP BY 1), q(name) AS (SELECT DISTINCT p_brand FROM part UNION ALL SELECT 'Brand#00')
SELECT name, CASE WHEN k IS NULL THEN 'unknown' WHEN k > 1 THEN 'ambiguous' ELSE 'ok' END AS status, CASE WHEN k = 1 THEN t END AS p_size FROM q LEFT JOIN a ON alias = name""")
def an49_name_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_brand", "p_size")
    asked = parts.select(F.col("p_brand").alias("name")).distinct().unionByName(spark.createDataFrame([("Brand#00",)], "name string"))
    return folds.resolve_names(asked, parts.withColumnRenamed("p_brand", "alias"), "name", "alias", "p_size")


@query("""WITH e AS (SELECT user_id, ts, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS s, event_id FROM events), g AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) < 21600 THEN 0 ELSE 1 END AS new FROM e), k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, event_id) AS sid FROM g)
SELECT user_id, min(s) AS started, count(*) AS n FROM k GROUP BY user_id, sid""")
def st_session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("at", F.date_trunc("second", F.col("ts").cast("timestamp")))
    # Spark joins windows that touch, so the gap is six hours less one microsecond: whole seconds six hours apart are two sessions.
    out = rows.groupBy("user_id", F.session_window("at", "21599 seconds 999999 microseconds")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.unix_seconds("session_window.start").alias("started"), "n")


@query("""SELECT event_type, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS day, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2""")
def st_tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("event_type", F.window(F.col("ts").cast("timestamp"), "1 day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"))
    return rows.select("event_type", F.unix_seconds("window.start").alias("day"), "n", "total")
