"""Store look-ups, quantity tables, band and box joins on the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spectraloom.functions import scalars as S
from spectraloom.operators import detect, graph, joins, reorganize
from spectraloom.sources import files
from spectraloom.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _n(name: str = "n"):
    return F.count("*").alias(name)


@query("""
SELECT o_orderpriority AS priority, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers, min(o_totalprice) AS least, max(o_totalprice) AS most
FROM orders WHERE TRY_CAST(o_totalprice AS DOUBLE) <= 250000 AND o_orderstatus <> 'P' GROUP BY 1""")
def a01_best_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where(S.keep_q(F.col("o_totalprice").cast("string"), 250000) & (F.col("o_orderstatus") != "P"))
    return o.groupBy(F.col("o_orderpriority").alias("priority")).agg(_n(), F.countDistinct("o_custkey").alias("customers"), F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"))


@query("""
WITH l AS (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1)
SELECT c_custkey, CAST(count(DISTINCT o_orderkey) AS BIGINT) AS orders, CAST(coalesce(sum(n), 0) AS BIGINT) AS lines, round(coalesce(sum(q), 0), 2) AS quantity
FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY 1""")
def a03_file_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(_n(), F.sum("l_quantity").alias("q"))  # noqa: E741
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(l, "o_orderkey", "left")
    per = o.groupBy("c_custkey").agg(_n("orders"), F.sum("n").alias("lines"), F.sum("q").alias("quantity"))
    out = table(spark, sf_dir, "customer").select("c_custkey").join(per, "c_custkey", "left").fillna(0)
    return out.select("c_custkey", "orders", "lines", F.round("quantity", 2).alias("quantity"))


@query("""
WITH u AS (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) <= 25)
SELECT l_suppkey AS protein, l_returnflag AS file, round(sum(l_extendedprice), 2) AS quantity FROM lineitem SEMI JOIN u USING (l_partkey) GROUP BY 1, 2""")
def a08_unique_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_extendedprice")  # noqa: E741
    unique = l.groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("k")).where("k <= 25")
    return l.join(unique, "l_partkey", "left_semi").groupBy(F.col("l_suppkey").alias("protein"), F.col("l_returnflag").alias("file")).agg(F.round(F.sum("l_extendedprice"), 2).alias("quantity"))


@query("""
SELECT l_partkey, min(l_discount) AS best, arg_min(l_suppkey, l_discount * 1e9 + l_suppkey) AS supplier FROM lineitem GROUP BY 1""")
def a12_arg_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy("l_partkey")
    return g.agg(F.min("l_discount").alias("best"), F.min_by("l_suppkey", F.struct("l_discount", "l_suppkey")).alias("supplier"))


@query("""
SELECT c_mktsegment AS segment, n_name AS nation, CAST(count(*) AS BIGINT) AS n, string_agg(CAST(c_custkey AS VARCHAR), ';' ORDER BY c_custkey) AS keys
FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY 1, 2""")
def a18_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    j = c.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy(F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation")).agg(_n(), S.join_unique(F.collect_set(F.col("c_custkey").cast("string"))).alias("keys"))


@query("""
SELECT 'customer' AS name, CAST(count(*) AS BIGINT) AS n FROM customer UNION ALL SELECT 'events', count(*) FROM events
UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part""")
def a22_table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda t: table(spark, sf_dir, t).agg(_n()).select(F.lit(t).alias("name"), "n")
    return one("customer").union(one("events")).union(one("orders")).union(one("part"))


@query("""
SELECT o_orderstatus AS status, CAST(floor(o_totalprice / 50000) AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1, 2""")
def a35_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.floor(F.col("o_totalprice") / 50000).alias("bin")).agg(_n())


@query("""
WITH a AS (SELECT s_suppkey, s_name AS alias FROM supplier UNION ALL SELECT s_suppkey, 'N' || s_nationkey FROM supplier),
r AS (SELECT 'N' || c_nationkey AS alias, c_custkey FROM customer WHERE c_acctbal > 9000)
SELECT s_suppkey, CAST(count(DISTINCT c_custkey) AS BIGINT) AS linked FROM a JOIN r USING (alias) GROUP BY 1""")
def j03_alias_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.array("s_name", F.concat(F.lit("N"), F.col("s_nationkey").cast("string")))).alias("alias"))
    r = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("alias"), "c_custkey")
    # Customers are counted by nation before they meet the suppliers: two aliases never share one.
    return s.join(r.groupBy("alias").agg(F.countDistinct("c_custkey").alias("k")), "alias").groupBy("s_suppkey").agg(F.sum("k").alias("linked"))


@query("SELECT l_orderkey, l_linenumber, o_orderdate, p_name FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE o_totalprice > 300000 AND p_size < 10")
def j06_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    p = table(spark, sf_dir, "part").where("p_size < 10").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return table(spark, sf_dir, "lineitem").join(o, "l_orderkey").join(p, "l_partkey").select("l_orderkey", "l_linenumber", "o_orderdate", "p_name")


@query("""
SELECT p_partkey, coalesce(n, 0) AS n, coalesce(s_nationkey, 0) AS nation FROM part LEFT JOIN (SELECT l_partkey, CAST(count(*) AS BIGINT) AS n, min(l_suppkey) AS s FROM lineitem
  WHERE l_quantity > 45 GROUP BY 1) q ON l_partkey = p_partkey LEFT JOIN supplier ON s_suppkey = s""")
def j08_left_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "lineitem").where("l_quantity > 45").groupBy(F.col("l_partkey").alias("p_partkey")).agg(_n(), F.min("l_suppkey").alias("s_suppkey"))
    j = table(spark, sf_dir, "part").join(q, "p_partkey", "left").join(table(spark, sf_dir, "supplier"), "s_suppkey", "left")
    return j.select("p_partkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("s_nationkey", F.lit(0)).alias("nation"))


@query("""
SELECT l_orderkey, CAST(count(*) AS BIGINT) AS observed, CAST(max(l_linenumber) AS BIGINT) AS expected FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1 HAVING count(*) <> max(l_linenumber)""")
def j13_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").groupBy("l_orderkey").agg(_n("observed"), F.max("l_linenumber").cast("long").alias("expected"))
    return g.where("observed <> expected")


@query("""
WITH a AS (SELECT p_partkey, p_retailprice AS x FROM part), e AS (SELECT a.p_partkey AS l, b.p_partkey AS r, b.x - a.x AS gap, row_number() OVER (PARTITION BY a.p_partkey ORDER BY abs(b.x - a.x - 1.0), b.p_partkey) AS n
  FROM a JOIN a b ON b.x - a.x > 0 AND b.x - a.x <= 1.0 + greatest(0.01, a.x * 10 / 1e6)) SELECT l, r, round(gap, 4) AS gap FROM e WHERE n = 1""")
def j18_best_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    a, b = p.select(F.col("p_partkey").alias("l"), F.col("p_retailprice").alias("x")), p.select(F.col("p_partkey").alias("r"), F.col("p_retailprice").alias("y"))
    gap = F.col("y") - F.col("x")
    pairs = joins.value_pairs(a, b, "x", "y", 1.5).where((gap > 0) & (gap <= 1.0 + S.ppm_tolerance(F.col("x"), 10, 0.01)))
    # Of a price the smallest key is the best; parts of one price have the same best.
    best = pairs.join(b.groupBy("y").agg(F.min("r").alias("r")), "y").groupBy("x").agg(F.min(F.struct(F.abs(gap - 1.0).alias("off"), "r", gap.alias("gap"))).alias("best"))
    return joins.keep_last(a.join(best, "x"), ["l"], [F.col("best.off"), F.col("best.r")]).select("l", "best.r", F.round("best.gap", 4).alias("gap"))


@query("""
SELECT a.p_partkey AS l, CAST(count(*) AS BIGINT) AS n FROM part a JOIN part b ON abs(a.p_retailprice - b.p_retailprice) <= a.p_retailprice * 40 / 1e6 AND a.p_partkey <> b.p_partkey GROUP BY 1""")
def j21_ppm_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    a, b = p.select(F.col("p_partkey").alias("l"), F.col("p_retailprice").alias("x")), p.select(F.col("p_partkey").alias("r"), F.col("p_retailprice").alias("y"))
    # Prices are compared and their parts counted; a part itself is taken off again.
    near = joins.ppm_join(a.select("x").distinct(), b.where("r IS NOT NULL").groupBy("y").agg(_n("k")), "x", "y", 40).groupBy("x").agg(F.sum("k").alias("k"))
    met = a.where("l IS NOT NULL").join(near, "x").groupBy("l").agg(F.sum("k").alias("k"))
    own = joins.ppm_join(a, b.withColumn("l", F.col("r")), "x", "y", 40, ["l"]).groupBy("l").agg(_n("own"))
    return met.join(own, "l", "left").select("l", (F.col("k") - F.coalesce("own", F.lit(0))).alias("n")).where("n > 0")


@query("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM part WHERE abs(p_retailprice - (s_acctbal / 10 + 1000)) <= p_retailprice * 20 / 1e6)")
def j24_exists_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "part").select(F.col("p_retailprice").alias("x"))
    b = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") / 10 + 1000).alias("y"))
    near = joins.ppm_join(a.distinct(), b.select("y").distinct(), "x", "y", 20).select("y").distinct()
    return b.join(near, "y", "left_semi").select("s_suppkey").distinct()


#: Events, and a box around each.
_ALL_BOXES = """
WITH e AS (SELECT event_id, user_id, value, epoch_us(ts) / 1e6 AS t FROM events),
b AS (SELECT event_id AS box, user_id AS u, t - 3600 AS t0, t + 3600 AS t1, value - 2 AS v0, value + 2 AS v1, value AS quality FROM e)
"""


def _boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events as points, and a box around each."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    v, t = F.col("value"), F.col("t")
    b = e.select(F.col("event_id").alias("box"), F.col("user_id").alias("u"), (t - 3600).alias("t0"), (t + 3600).alias("t1"), (v - 2).alias("v0"), (v + 2).alias("v1"), v.alias("quality"))
    return e, b


_OVERLAP = "SELECT a.box AS l, b.box AS r FROM b a JOIN b ON a.u = b.u AND a.box < b.box AND a.t0 < b.t1 AND b.t0 < a.t1 AND a.v0 < b.v1 AND b.v0 < a.v1"


def _overlap(b: DataFrame) -> DataFrame:
    a, c = b.toDF(*[f"l_{x}" for x in b.columns]), b.toDF(*[f"r_{x}" for x in b.columns])
    j = joins.overlap_join(a.withColumnRenamed("l_u", "u"), c.withColumnRenamed("r_u", "u"), "u", "l_t0", "l_t1", "r_t0", "r_t1", 7200.0)
    return j.where("l_box < r_box AND l_v0 < r_v1 AND r_v0 < l_v1").select(F.col("l_box").alias("l"), F.col("r_box").alias("r"))


@query(_ALL_BOXES + _OVERLAP)
def j26_box_overlap_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlap(_boxes(spark, sf_dir)[1])


_IN_BOX = """, j AS (SELECT event_id, box, row_number() OVER (PARTITION BY event_id ORDER BY quality DESC, box) AS n FROM e JOIN b ON user_id = u AND t BETWEEN t0 AND t1 AND value BETWEEN v0 AND v1)
SELECT event_id, box FROM j WHERE n = 1"""


def _in_box(e: DataFrame, b: DataFrame) -> DataFrame:
    return joins.points_in_boxes(e, b, "user_id", "u", ("t", "t0", "t1"), ("value", "v0", "v1"), 7200.0, ["event_id"], [F.desc("quality"), F.asc("box")]).select("event_id", "box")


@query(_ALL_BOXES + _IN_BOX)
def j27_point_in_box_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_box(*_boxes(spark, sf_dir))


_CLASS = """, j AS (SELECT event_id, min(CASE WHEN quality > 60 THEN 0 WHEN quality > 30 THEN 1 ELSE 2 END) AS c FROM e JOIN b ON user_id = u AND t BETWEEN t0 AND t1 AND value BETWEEN v0 AND v1 GROUP BY 1)
SELECT event_id, CAST(coalesce(c, 3) AS INTEGER) AS class FROM e LEFT JOIN j USING (event_id)"""


def _class(e: DataFrame, b: DataFrame) -> DataFrame:
    c = F.when(F.col("quality") > 60, 0).when(F.col("quality") > 30, 1).otherwise(2)
    best = joins.points_in_boxes(e, b.withColumn("c", c), "user_id", "u", ("t", "t0", "t1"), ("value", "v0", "v1"), 7200.0, ["event_id"], [F.asc("c")]).select("event_id", "c")
    return e.join(best, "event_id", "left").select("event_id", F.coalesce("c", F.lit(3)).alias("class"))


@query(_ALL_BOXES + _CLASS)
def a28_point_class_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _class(*_boxes(spark, sf_dir))


@query("""
SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000 AND o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'
ORDER BY o_orderpriority, abs(o_totalprice - 150000), o_orderkey LIMIT 40""")
def j29_candidates_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of every customer, in a window of dates."""
    o = table(spark, sf_dir, "orders").where("o_totalprice BETWEEN 100000 AND 200000 AND o_orderstatus = 'O' AND o_orderdate >= '1997-01-01' AND o_orderdate < '1999-01-01'")
    return o.orderBy("o_orderpriority", F.abs(F.col("o_totalprice") - 150000), "o_orderkey").limit(40).select("o_orderkey", "o_totalprice", "o_orderpriority")


@query("""
WITH s AS (SELECT s_suppkey, s_acctbal / 10 + 1000 AS y, unnest(range(-1, 3)) AS k FROM supplier)
SELECT DISTINCT s_suppkey, p_partkey FROM s JOIN part ON abs(p_retailprice - (y + k * 1.00335)) <= 0.2""")
def j30_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Keys are grouped by the values they have, and groups meet once: pairs of keys are then distinct without being compared.
    b = table(spark, sf_dir, "supplier").groupBy("s_suppkey").agg(F.array_sort(F.collect_set(F.col("s_acctbal") / 10 + 1000)).alias("ys"))
    a = table(spark, sf_dir, "part").groupBy("p_partkey").agg(F.array_sort(F.collect_set("p_retailprice")).alias("xs"))
    y = b.select("ys").distinct().select("ys", F.explode("ys").alias("y0"), F.expr("sequence(-1, 2)").alias("k")).select("ys", F.explode("k").alias("k"), "y0").select("ys", (F.col("y0") + F.col("k") * 1.00335).alias("y"))
    pairs = joins.band_join(a.select("xs").distinct().select("xs", F.explode("xs").alias("x")), y, "x", "y", 0.2).select("xs", "ys").distinct()
    return b.join(pairs, "ys").join(a, "xs").select("s_suppkey", "p_partkey")


@query("""
WITH j AS (SELECT s_suppkey, p_partkey, row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(p_retailprice - (s_acctbal / 10 + 1000)), abs(p_size - 25), p_partkey) AS n
  FROM supplier JOIN part ON abs(p_retailprice - (s_acctbal / 10 + 1000)) <= 5) SELECT s_suppkey, p_partkey FROM j WHERE n = 1""")
def j31_nearest_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.col("p_retailprice").alias("x"))
    b = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") / 10 + 1000).alias("y"))
    # The best part of a price is the same for every supplier, and the best part of a balance for all suppliers that have it.
    first = a.groupBy("x").agg(F.min(F.struct(F.abs(F.col("p_size") - 25).alias("size"), "p_partkey")).alias("p"))
    best = joins.value_pairs(a, b, "x", "y", 5.0).join(first, "x").groupBy("y").agg(F.min(F.struct(F.abs(F.col("x") - F.col("y")).alias("gap"), "p")).alias("best"))
    return b.join(best, "y").groupBy("s_suppkey").agg(F.min("best").alias("best")).select("s_suppkey", "best.p.p_partkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 250000)")
def j36_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F' AND o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey"))
    return reorganize.identified(table(spark, sf_dir, "customer"), o, "c_custkey").select("c_custkey", "c_name")


@query("""
WITH f AS (SELECT p_partkey AS id, p_retailprice AS mz, p_size AS h FROM part),
e AS (SELECT a.id AS l, b.id AS r, b.mz - a.mz AS gap, a.mz AS m, a.h AS ha, b.h AS hb FROM f a JOIN f b ON b.mz > a.mz AND b.mz - a.mz <= 1.00335483507 + greatest(0.004, (a.mz + 1.00335483507) * 10 / 1e6)),
z AS (SELECT *, CAST(round_even(1.00335483507 / gap, 0) AS INTEGER) AS z FROM e),
o AS (SELECT *, CAST(1.007276554940804 AS DOUBLE) / z - gap AS off, CAST(1.007276554940804 AS DOUBLE) / z * 0.1 AS cut FROM z WHERE z >= 1),
k AS (SELECT l, r, z, 0.5 * (1 - least(1, abs(off) / (cut + 0.002))) + 0.35 + 0.15 * (1 - least(1, abs(log2(ha / hb)) / 4)) AS score FROM o
  WHERE off > -(cut * 0.1 + 0.002) AND off <= cut + 0.002 AND (m - 1.007276554940804) * z BETWEEN 1e-9 AND 8000 AND greatest(ha, hb) / least(ha, hb) <= 10)
SELECT CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, z AS charge, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY l, z ORDER BY score DESC, r) AS n FROM k WHERE score >= 0.3) WHERE n = 1""")
def d09_isotope_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.lit(1.0)
    p = table(spark, sf_dir, "part").select(
        F.lit(1).alias("file_id"), F.col("p_partkey").alias("feature_id"), F.col("p_retailprice").alias("mz_mean"), F.lit(0.0).alias("rt_start"), (one / 2).alias("rt_apex"), one.alias("rt_end"), F.col("p_size").cast("double").alias("height")
    )
    e = detect.isotope_edges(p)
    return e.select(F.col("left_feature_id").alias("l"), F.col("right_feature_id").alias("r"), "charge", F.round("score", 4).alias("score"))


@query(None)
def d03_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of events: a user is a file, an hour a scan, the value an m/z."""
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9)
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("file_id"), hour.alias("hour"), F.col("value").alias("mz"), F.lit(1.0).alias("intensity"))
    scans = e.select("file_id", "hour").distinct().withColumn("scan", (F.row_number().over(W.partitionBy("file_id").orderBy("hour")) - 1).cast("long"))
    pts = e.join(scans, ["file_id", "hour"]).select("file_id", "scan", F.col("scan").cast("double").alias("rt"), "mz", "intensity")
    wide = detect.Settings(line_abs=0.5, merge_abs=0.8, least_points=2)
    return detect.line_table(detect.lines(pts, wide), wide).drop("long")


@query(None)
def d08_split_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as one long trace, cut into its peaks; a valley of less than 0.6 of the smaller top parts two."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 6e7
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("file_id"), at.alias("rt"), F.col("value").alias("intensity"), F.lit(1.0).alias("island"), F.lit(0).cast("long").alias("line"), F.lit(1.0).alias("mz"), F.col("event_id").alias("scan"))
    whole = e.select("file_id", "island", "line").distinct().withColumn("long", F.lit(True))
    cut = detect.pieces(e, whole, detect.Settings(valley=0.6, peak_width=1e9, peak_height=2.0, peak_area=5.0, peak_points=3))
    return cut.groupBy("file_id", "piece").agg(F.min("rt").alias("rt_start"), F.max("rt").alias("rt_end"), F.max("intensity").alias("height"), F.count("*").alias("n_points"))


@query("""
SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(json_valid(props) AS BOOLEAN) AS valid FROM events""")
def src10_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"), files.is_json(F.col("props")).alias("valid"))


@query("""
SELECT page_id, CAST(len(list_distinct(regexp_extract_all(html, 'href\\s*=\\s*["'']([^"''#]+)', 1))) AS BIGINT) AS links FROM pages""")
def src17_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.size(files.links(F.col("html"))).cast("long").alias("links"))


_HREF = """href\\s*=\\s*["'']([^"''#]+)"""


@query(f"""
WITH RECURSIVE p AS (SELECT regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS root, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/[^/]*$', '') AS folder, html FROM pages),
e AS (SELECT DISTINCT folder AS a, CASE WHEN l LIKE '/%' THEN root || l WHEN regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN l ELSE folder || '/' || l END AS b
  FROM (SELECT *, unnest(regexp_extract_all(html, '{_HREF}', 1)) AS l FROM p)),
r(start, node, depth) AS (SELECT DISTINCT folder, folder, 0 FROM p UNION SELECT r.start, e.b, r.depth + 1 FROM r JOIN e ON r.node = e.a WHERE r.depth < 12)
SELECT start, node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY 1, 2""")
def src17_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each folder of pages leads to: links of its pages, of the folders among these, and so on."""
    pages = table(spark, sf_dir, "pages")
    folder = files.folder_of(F.col("url"))
    links = pages.select(folder.alias("a"), "url", F.explode(files.links(F.col("html"))).alias("link"))
    edges = links.select("a", files.resolve(F.col("url"), F.col("link")).alias("b"))
    return graph.reachable(edges, pages.select(folder.alias("start")))
