"""Job-domain relations projected from star-schema tables, and the same projections as SQL.

``orders`` are batches, ``lineitem`` rows are jobs and their completions, ``part`` rows are job
handlers, ``events`` is an append-only log, ``customer`` and ``supplier`` are tenants and consumers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "1998-06-01 00:00:00"
LOG_NOW = "2024-01-20 00:00:00"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def at(moment: str) -> Column:
    return F.lit(moment).cast("timestamp_ntz")


class Relations:
    """Lazily read tables and projections of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        raise AttributeError(name)

    @property
    def batches(self) -> DataFrame:
        return self.orders.select(
            F.col("o_orderkey").alias("batch_id"), F.col("o_custkey").alias("tenant_id"), F.col("o_orderdate").alias("created_at"),
            F.when(F.col("o_orderkey") % 97 == 0, "cancelled").otherwise("running").alias("status"),
            (F.col("o_orderkey") % 13 != 0).alias("sealed"), F.col("o_orderstatus").alias("hint"), F.col("o_orderpriority").alias("priority"),
        )

    @property
    def completions(self) -> DataFrame:
        op = F.when(F.col("l_returnflag") == "N", "success").when(F.col("l_returnflag") == "R", "failed").otherwise("executed")
        return self.lineitem.select(
            F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").cast("bigint").alias("batch_seq"), op.alias("op"), F.col("l_shipdate").alias("occurred_at"),
            F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice").alias("arrival"),
        )

    @property
    def totals(self) -> DataFrame:
        """Distinct lines per order; an order has few, so a set per order saves a second exchange."""
        return self.lineitem.groupBy(F.col("l_orderkey").alias("batch_id")).agg(F.size(F.collect_set("l_linenumber")).cast("bigint").alias("total_jobs"))

    @property
    def jobs(self) -> DataFrame:
        k = F.col("l_partkey") % 6
        expiry = F.when(k == 0, "").when(k == 1, "not-a-time").when(k == 2, None).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        e = F.col("l_suppkey") % 10
        return self.lineitem.select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("bigint")).alias("job_id"),
            F.when(F.col("l_orderkey") % 11 != 0, F.col("l_orderkey")).alias("batch_id"), F.concat(F.lit("jt"), "l_partkey").alias("job_type"),
            (F.col("l_quantity").cast("int") % 9).alias("attempt"), F.col("l_linenumber").cast("bigint").alias("batch_seq"), (F.col("l_linestatus") == "F").alias("batch_counted"),
            expiry.alias("valid_till"), (F.col("l_returnflag") == "N").alias("ok"),
            F.when(e == 0, "UnknownHandler").when(e == 1, "Overloaded").when(e == 2, None).otherwise("Timeout").alias("error_class"),
            F.when(F.col("l_suppkey") % 4 != 0, F.concat(F.lit("t"), F.col("l_suppkey") % 40)).alias("tenant_id"),
            F.col("l_shipdate").alias("run_at"), F.col("l_suppkey").alias("consumer_id"), F.col("l_quantity").alias("duration"), (F.col("l_tax") >= 0.06).alias("malformed"),
            (F.col("l_partkey") % 16).cast("int").alias("partition_id"),
        )

    @property
    def manifest(self) -> DataFrame:
        """Handlers of most parts' job types; forty neighbours share a topic."""
        return self.part.where("p_partkey % 25 < 23").select(F.col("p_partkey").alias("id")).select(
            F.concat(F.lit("jt"), "id").alias("job_type"), F.when(F.col("id") % 5 == 4, "ruby").otherwise("go").alias("runtime"),
            F.concat(F.lit("class"), "id").alias("worker_class"), F.concat(F.lit("topic"), F.floor(F.col("id") / 40)).alias("topic"), (F.col("id") % 4).cast("int").alias("max_retries"),
            F.element_at(F.array(F.lit(""), F.lit("short"), F.lit("medium"), F.lit("large"), F.lit("bogus")), (F.col("id") % 5 + 1).cast("int")).alias("retry_tier"),
            F.when(F.col("id") % 6 == 0, "throughput").when(F.col("id") % 6 == 1, "time").otherwise("").alias("fairness_type"),
        )

    @property
    def log(self) -> DataFrame:
        from pyspark.sql import Window

        base = self.events.select(
            F.concat(F.lit("jobs"), F.col("event_id") % 3).alias("topic"), (F.col("user_id") % 16).cast("int").alias("partition_id"), "ts", "event_id", "value", "event_type", "user_id", "props",
            F.when((F.col("event_type") == "error") & (F.col("value") > 120), "failed").when((F.col("event_type") == "signup") & (F.col("value") > 150), "pending").otherwise("done").alias("state"),
        )
        return base.withColumn("offset", (F.row_number().over(Window.partitionBy("topic", "partition_id").orderBy("ts", "event_id")) - 1).cast("bigint"))


#: Fixed values of the projections above, as SQL.
SQL = f"""
batches AS (SELECT o_orderkey AS batch_id, o_custkey AS tenant_id, o_orderdate AS created_at, CASE WHEN o_orderkey % 97 = 0 THEN 'cancelled' ELSE 'running' END AS status,
  o_orderkey % 13 != 0 AS sealed, o_orderstatus AS hint, o_orderpriority AS priority FROM orders),
completions AS (SELECT l_orderkey AS batch_id, l_linenumber::BIGINT AS batch_seq, CASE l_returnflag WHEN 'N' THEN 'success' WHEN 'R' THEN 'failed' ELSE 'executed' END AS op,
  l_shipdate AS occurred_at, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS ord FROM lineitem),
totals AS (SELECT l_orderkey AS batch_id, count(DISTINCT l_linenumber) AS total_jobs FROM lineitem GROUP BY 1),
jobs AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, trunc(l_extendedprice)::BIGINT) AS job_id,
  CASE WHEN l_orderkey % 11 != 0 THEN l_orderkey END AS batch_id, 'jt' || l_partkey AS job_type, (l_quantity::INT % 9)::INT AS attempt, l_linenumber::BIGINT AS batch_seq,
  l_linestatus = 'F' AS batch_counted,
  CASE l_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'not-a-time' WHEN 2 THEN NULL ELSE strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') END AS valid_till,
  l_returnflag = 'N' AS ok, CASE l_suppkey % 10 WHEN 0 THEN 'UnknownHandler' WHEN 1 THEN 'Overloaded' WHEN 2 THEN NULL ELSE 'Timeout' END AS error_class,
  CASE WHEN l_suppkey % 4 != 0 THEN 't' || (l_suppkey % 40) END AS tenant_id, l_shipdate AS run_at, l_suppkey AS consumer_id, l_quantity AS duration, l_tax >= 0.06 AS malformed,
  (l_partkey % 16)::INT AS partition_id FROM lineitem),
manifest AS (SELECT 'jt' || id AS job_type, CASE WHEN id % 5 = 4 THEN 'ruby' ELSE 'go' END AS runtime, 'class' || id AS worker_class, 'topic' || (id // 40) AS topic, (id % 4)::INT AS max_retries,
  ['', 'short', 'medium', 'large', 'bogus'][id % 5 + 1] AS retry_tier, CASE id % 6 WHEN 0 THEN 'throughput' WHEN 1 THEN 'time' ELSE '' END AS fairness_type FROM (SELECT p_partkey AS id FROM part WHERE p_partkey % 25 < 23)),
log AS (SELECT 'jobs' || (event_id % 3) AS topic, (user_id % 16)::INT AS partition_id, ts, event_id, value, event_type, user_id, props,
  CASE WHEN event_type = 'error' AND value > 120 THEN 'failed' WHEN event_type = 'signup' AND value > 150 THEN 'pending' ELSE 'done' END AS state,
  (row_number() OVER (PARTITION BY event_id % 3, user_id % 16 ORDER BY ts, event_id) - 1)::BIGINT AS "offset" FROM events),
clock AS (SELECT TIMESTAMP '{NOW}' AS now, TIMESTAMP '{LOG_NOW}' AS log_now)
"""
