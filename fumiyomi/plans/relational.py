"""The relational operators that the engine's plans are made of, each over the star tables with its own SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fumiyomi.plans.queries import query, r6, table


def _money(c: str = "l_extendedprice") -> Column:
    return F.col(c).cast("decimal(18,2)")


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS quantity, round(avg(l_discount), 6) AS discount, count(*) FILTER (l_tax > 0.05) AS taxed FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01' GROUP BY ALL""")
def filtered_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").filter(F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum(_money("l_quantity")).cast("double").alias("quantity"), r6(F.avg("l_discount")).alias("discount"), F.count_if(F.col("l_tax") > 0.05).alias("taxed"))


@query("""SELECT r_name, n_name, count(*) AS orders, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def star_join(spark, sf):
    """Nations and regions are dimensions of a known, fixed size; customers and orders are joined as their sizes ask for."""
    dims = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(F.broadcast(dims), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("orders"), F.sum(_money("o_totalprice")).cast("double").alias("total"))


@query("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def left_join_zero_fill(spark, sf):
    counts = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"))
    return table(spark, sf, "customer").select("c_custkey").join(counts, "c_custkey", "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def anti_join(spark, sf):
    """Customers without an urgent order."""
    urgent = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'")
    return table(spark, sf, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 50)")
def semi_join(spark, sf):
    large = table(spark, sf, "lineitem").filter("l_quantity >= 50").select("l_orderkey")
    return table(spark, sf, "orders").join(large, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n, sum(c_acctbal::DECIMAL(18,2))::DOUBLE AS balance FROM customer GROUP BY GROUPING SETS ((c_mktsegment, c_nationkey), (c_mktsegment), ())")
def grouping_sets(spark, sf):
    rows = table(spark, sf, "customer").groupingSets([["c_mktsegment", "c_nationkey"], ["c_mktsegment"], []], "c_mktsegment", "c_nationkey")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(_money("c_acctbal")).cast("double").alias("balance"))


@query("SELECT o_custkey, o_orderkey, date_diff('day', lag(o_orderdate) OVER w, o_orderdate)::BIGINT AS since, row_number() OVER w AS nth FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def lag_and_row_number(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.datediff("o_orderdate", F.lag("o_orderdate").over(w)).cast("long").alias("since"), F.row_number().over(w).cast("long").alias("nth"))


@query("""WITH g AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 1 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id, session::BIGINT AS session, count(*) AS events FROM s GROUP BY ALL""")
def event_islands(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf, "events").withColumn("before", F.lag("ts").over(w))
    new = F.col("before").isNull() | (F.col("ts") > F.col("before") + F.expr("INTERVAL 1 HOUR"))
    rows = rows.withColumn("session", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("events"))


@query("SELECT o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '2-HIGH') AS high, count(*) FILTER (o_orderpriority = '5-LOW') AS low FROM orders GROUP BY 1")
def pivot(spark, sf):
    rows = table(spark, sf, "orders").groupBy("o_orderstatus").pivot("o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW"]).agg(F.count(F.lit(1)))
    names = {"1-URGENT": "urgent", "2-HIGH": "high", "5-LOW": "low"}
    return rows.select("o_orderstatus", *[F.coalesce(F.col(f"`{a}`"), F.lit(0)).alias(b) for a, b in names.items()])


@query("SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 3")
def top_of_each(spark, sf):
    """A report of the three dearest parts of each brand; partial limits go before the shuffle."""
    w = Window.partitionBy("p_brand").orderBy(F.col("p_retailprice").desc(), "p_partkey")
    return table(spark, sf, "part").withColumn("r", F.row_number().over(w)).filter("r <= 3").select("p_brand", "p_partkey", "p_retailprice")


@query("SELECT l_suppkey AS suppkey, count(*) AS n FROM (SELECT l_suppkey FROM lineitem UNION ALL SELECT s_suppkey FROM supplier) GROUP BY 1 HAVING count(*) > 1")
def union_having(spark, sf):
    both = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("suppkey")).unionByName(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("suppkey")))
    return both.groupBy("suppkey").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("SELECT event_type, count(DISTINCT user_id) AS users, round(corr(value, event_id), 6) AS r, max_by(event_id, value) AS top FROM events WHERE value IS NOT NULL GROUP BY 1".replace("max_by(event_id, value)", "arg_max(event_id, {'v': value, 'k': event_id})"))
def event_statistics(spark, sf):
    x, y = F.col("value"), F.col("event_id").cast("double")
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    rows = table(spark, sf, "events").filter("value is not null").groupBy("event_type")
    return rows.agg(F.count_distinct("user_id").alias("users"), r6(r).alias("r"), F.max_by("event_id", F.struct("value", "event_id")).alias("top"))


@query("SELECT conv_id, string_agg(role, '/' ORDER BY turn) AS roles, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id")
def ordered_lists(spark, sf):
    roles = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), "/")
    return table(spark, sf, "conversations").groupBy("conv_id").agg(roles.alias("roles"), F.sum(F.length("text")).alias("chars"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_field(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k")).filter("k is not null")
