"""Joins, pivots, windows and aggregates on the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spectraloom.functions import scalars as S
from spectraloom.operators import joins
from spectraloom.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""
SELECT p_partkey, 'K.' || upper(p_brand) || '[+15.99]M.R' AS raw,
  regexp_replace(upper(p_brand) || 'M', '[^A-Z]', '', 'g') AS plain, 'K' AS left_flank, 'R' AS right_flank, CAST(15.99 AS DOUBLE) AS mod_mass,
  p_type LIKE 'PROMO%' AS decoy, TRY_CAST(nullif(trim(p_type), '') AS DOUBLE) IS NULL AS not_number
FROM part""")
def sc_peptide_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("K."), F.upper("p_brand"), F.lit("[+15.99]M.R"))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", raw.alias("raw"))
    bare = S.strip_flanks(F.col("raw"))
    return p.select(
        "p_partkey", "raw", S.strip_mods(bare).alias("plain"), S.left_flank(F.col("raw")).alias("left_flank"), S.right_flank(F.col("raw")).alias("right_flank"),
        S.mod_mass(F.col("raw")).alias("mod_mass"), F.startswith("p_type", F.lit("PROMO")).alias("decoy"), S.to_double(F.col("p_type")).isNull().alias("not_number"),
    )


@query("""
SELECT p_partkey, round((p_retailprice - 1.007276554940804) * p_size, 4) AS neutral, round(greatest(0.01, p_retailprice * 20 / 1e6), 6) AS tol,
  round(p_retailprice / p_size + 1.007276554940804 + 2 * 1.00335483507 / p_size, 4) AS third,
  round(1 - least(1.0, abs(log2(p_retailprice / p_size)) / 4), 4) AS score
FROM part""")
def sc_masses(spark: SparkSession, sf_dir: str) -> DataFrame:
    mz, z = F.col("p_retailprice"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.round(S.neutral_mass(mz, z), 4).alias("neutral"), F.round(S.ppm_tolerance(mz, 20, 0.01), 6).alias("tol"),
        F.round(F.get(S.isotope_mzs(mz, z, 3), F.lit(2)), 4).alias("third"), F.round(S.intensity_score(mz, z.cast("double")), 4).alias("score"),
    )


@query("""
SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ';' ORDER BY o_orderpriority) AS priorities, CAST(count(*) AS BIGINT) AS n,
  min(o_totalprice) AS best FROM orders GROUP BY o_custkey""")
def a02_distinct_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy("o_custkey")
    return o.agg(S.join_unique(F.collect_set("o_orderpriority")).alias("priorities"), F.count("*").alias("n"), F.min("o_totalprice").alias("best"))


@query("""
WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
SELECT c_custkey, coalesce(o_orderstatus, 'none') AS status, o_totalprice FROM customer LEFT JOIN (SELECT * FROM o WHERE n = 1) q ON c_custkey = o_custkey""")
def j01_left_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = joins.keep_last(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return c.join(last, c.c_custkey == last.o_custkey, "left").select("c_custkey", F.coalesce("o_orderstatus", F.lit("none")).alias("status"), "o_totalprice")


@query("""
WITH a AS (SELECT o_custkey AS k, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY 1),
b AS (SELECT c_custkey AS k, c_acctbal AS bal FROM customer WHERE c_acctbal > 5000)
SELECT coalesce(a.k, b.k) AS k, n, bal FROM a FULL OUTER JOIN b ON a.k = b.k""")
def j04_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").where("o_totalprice > 200000").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    b = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"))
    return a.join(b, "k", "full_outer").select("k", "n", "bal")


@query("""
SELECT n_name, CAST(count(o_orderkey) AS BIGINT) AS n_orders, round(coalesce(sum(o_totalprice), 0), 2) AS total
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_name""")
def j09_rollup_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Orders are summed by customer first: the wide joins then carry one row a customer.
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("t"))
    c = table(spark, sf_dir, "customer").join(o, "c_custkey", "left").groupBy("c_nationkey").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    n = table(spark, sf_dir, "nation")
    return n.join(c, n.n_nationkey == c.c_nationkey, "left").select("n_name", F.coalesce("n", F.lit(0)).alias("n_orders"), F.round(F.coalesce("t", F.lit(0.0)), 2).alias("total"))


@query("""
SELECT l_suppkey, l_returnflag, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag
  ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1""")
def j12_one_per_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = joins.keep_last(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_returnflag"], [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")])
    return best.select("l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber")


@query("""
SELECT a.p_partkey AS l, b.p_partkey AS r FROM part a JOIN part b ON a.p_partkey < b.p_partkey AND abs(a.p_retailprice - b.p_retailprice) <= 0.05""")
def j20_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    a = p.select(F.col("p_partkey").alias("l"), F.col("p_retailprice").alias("x"))
    b = p.select(F.col("p_partkey").alias("r"), F.col("p_retailprice").alias("y"))
    return joins.band_join(a, b, "x", "y", 0.05).where("l < r").select("l", "r")


@query("""
WITH p AS (SELECT a.p_partkey AS l, b.s_suppkey AS r, abs(a.p_retailprice - (s_acctbal / 10 + 1000)) AS d FROM part a JOIN supplier b
  ON abs(a.p_retailprice - (s_acctbal / 10 + 1000)) < 3)
SELECT l, r, round(d, 4) AS d FROM (SELECT *, rank() OVER (PARTITION BY l ORDER BY d) AS n FROM p) WHERE n = 1""")
def j22_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l"), F.col("p_retailprice").alias("x"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("r"), (F.col("s_acctbal") / 10 + 1000).alias("y"))
    return joins.nearest_join(a, b, "l", "x", "y", 3.0).select("l", "r", F.round(F.abs(F.col("x") - F.col("y")), 4).alias("d"))


@query("""
SELECT event_id, last_value(CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN event_id END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS source FROM events""")
def j32_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = e.agg(F.min("event_type").alias("_kind"))
    rows = e.crossJoin(F.broadcast(kind))  # one row
    return joins.preceding(rows, "user_id", ["ts", "event_id"], F.col("event_type") == F.col("_kind"), F.col("event_id"), "source").select("event_id", "source")


@query("SELECT l_orderkey, l_linenumber, 'quantity' AS name, l_quantity AS value FROM lineitem WHERE l_quantity <> 0 UNION ALL SELECT l_orderkey, l_linenumber, 'tax', l_tax FROM lineitem WHERE l_tax <> 0")
def a04_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("tax"))
    return wide.unpivot(["l_orderkey", "l_linenumber"], ["quantity", "tax"], "name", "value").where(~F.col("value").eqNullSafe(0.0))


@query("""
SELECT l_suppkey, round(avg(CASE WHEN l_returnflag = 'A' AND l_extendedprice > 0 THEN l_extendedprice END), 2) AS a,
  round(avg(CASE WHEN l_returnflag = 'N' AND l_extendedprice > 0 THEN l_extendedprice END), 2) AS n,
  round(avg(CASE WHEN l_returnflag = 'R' AND l_extendedprice > 0 THEN l_extendedprice END), 2) AS r FROM lineitem GROUP BY l_suppkey""")
def a16_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.avg(F.when(F.col("l_extendedprice") > 0, F.col("l_extendedprice"))))
    return cells.select("l_suppkey", *[F.round(x, 2).alias(x.lower()) for x in "ANR"])


@query("SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS part FROM orders GROUP BY o_orderstatus")
def a20_group_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("_all")))).select("o_orderstatus", "n", F.round(F.col("n") / F.col("_all"), 6).alias("part"))


@query("""
SELECT l_shipmode_flag AS flag, round(min(x), 4) AS p0, round(quantile_cont(x, 0.01), 4) AS p1, round(quantile_cont(x, 0.5), 4) AS p50, round(quantile_cont(x, 0.99), 4) AS p99,
  round(max(x), 4) AS p100 FROM (SELECT l_returnflag AS l_shipmode_flag, l_extendedprice AS x FROM lineitem) GROUP BY 1""")
def a21_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.percentile("l_extendedprice", [0.0, 0.01, 0.5, 0.99, 1.0]).alias("q"))
    return q.select("flag", *[F.round(F.get("q", F.lit(i)), 4).alias(f"p{p}") for i, p in enumerate((0, 1, 50, 99, 100))])


@query("""
SELECT user_id, CAST(floor(value / 5) AS BIGINT) AS bin, round(max(value), 6) AS top, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2""")
def a26_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id", F.floor(F.col("value") / 5).alias("bin"))
    return e.agg(F.round(F.max("value"), 6).alias("top"), F.count("*").alias("n"))


@query("""
WITH e AS (SELECT user_id, value, epoch_us(ts) / 1e6 AS t, event_id FROM events),
g AS (SELECT *, lag(t) OVER w AS t0, lag(value) OVER w AS v0 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT user_id, round(coalesce(sum((t - t0) * (value + v0) / 2), 0), 1) AS area, round(max(value), 6) AS height FROM g GROUP BY user_id""")
def a29_trapezoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    e = table(spark, sf_dir, "events").select("user_id", "value", "event_id", t.alias("t"))
    w = W.partitionBy("user_id").orderBy("t", "event_id")
    slab = (F.col("t") - F.lag("t").over(w)) * (F.col("value") + F.lag("value").over(w)) / 2
    return e.withColumn("slab", slab).groupBy("user_id").agg(F.round(F.coalesce(F.sum("slab"), F.lit(0.0)), 1).alias("area"), F.round(F.max("value"), 6).alias("height"))


@query("""
WITH e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t FROM events),
g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > 3600 THEN 1 ELSE 0 END AS new FROM e),
i AS (SELECT user_id, t, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id) AS island FROM g)
SELECT user_id, CAST(island AS BIGINT) AS island, CAST(count(*) AS BIGINT) AS n, round(max(t) - min(t), 3) AS span FROM i GROUP BY 1, 2""")
def i05_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    e = table(spark, sf_dir, "events").select("user_id", "event_id", t.alias("t"))
    found = joins.islands(e, "user_id", ["t", "event_id"], F.col("t"), 3600)
    return found.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.round(F.max("t") - F.min("t"), 3).alias("span"))


@query("""
WITH v AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings),
c AS (SELECT label, i, sum(x) AS s FROM v GROUP BY 1, 2)
SELECT vec_id, round(sum(x * s) / sqrt(sum(x * x) * sum(s * s)), 4) AS cosine FROM v JOIN c ON v.label = c.label AND v.i = c.i GROUP BY vec_id""")
def d13_consensus_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    c = v.groupBy("label", "i").agg(F.sum("x").alias("s"))
    sums = v.join(c, ["label", "i"]).groupBy("vec_id").agg(F.sum(F.col("x") * F.col("s")).alias("xs"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("s") * F.col("s")).alias("ss"))
    return sums.select("vec_id", F.round(F.col("xs") / F.sqrt(F.col("xx") * F.col("ss")), 4).alias("cosine"))


@query("""
WITH s AS (SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS q FROM documents),
p AS (SELECT doc_id, q, unnest(range(1, length(q))) AS i FROM s)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_sites, CAST(sum(i) AS BIGINT) AS sum_sites FROM p
WHERE substr(q, i, 1) IN ('K', 'R') AND substr(q, i + 1, 1) <> 'P' GROUP BY doc_id""")
def i12_cleavage_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    # Text is cut into pieces once; looking residues up by position would walk the text every time.
    r = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(q, "(?<=[KR])(?=[A-OQ-Z])")).alias("i", "piece"))
    by = W.partitionBy("doc_id").orderBy("i")
    ends = r.select("doc_id", F.sum(F.length("piece")).over(by).alias("at"), F.lead("i").over(by).alias("next")).where("next IS NOT NULL")
    return ends.groupBy("doc_id").agg(F.count("*").alias("n_sites"), F.sum("at").cast("long").alias("sum_sites"))


@query("""
WITH s AS (SELECT upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS q, doc_id, source FROM documents)
SELECT md5(q) AS seq, min(doc_id) AS representative, CAST(count(*) AS BIGINT) AS n FROM s WHERE q <> '' GROUP BY q""")
def m01_dedup_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("doc_id", F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("q")).where("q <> ''")
    return s.groupBy(F.md5("q").alias("seq")).agg(F.min("doc_id").alias("representative"), F.count("*").alias("n"))


@query("""
WITH s AS (SELECT DISTINCT p_partkey, regexp_replace(upper(p_name), '[^A-Z]', '', 'g') AS q FROM part),
w AS (SELECT p_partkey, substr(q, i, 5) AS win FROM (SELECT p_partkey, q, unnest(range(1, greatest(length(q) - 3, 1))) AS i FROM s) WHERE length(substr(q, i, 5)) = 5)
SELECT substr(win, 1, 1) AS first, substr(win, 5, 1) AS last, CAST(count(*) AS BIGINT) AS hits, CAST(count(DISTINCT p_partkey) AS BIGINT) AS proteins FROM w
WHERE NOT regexp_matches(win, '[BJOXZU]') GROUP BY 1, 2""")
def m03_endpoint_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace(F.upper("p_name"), "[^A-Z]", "").alias("q")).where("length(q) >= 5")
    w = s.select("p_partkey", F.explode(F.transform(F.sequence(F.lit(1), F.length("q") - 4), lambda i: F.substr(F.col("q"), i, F.lit(5)))).alias("win")).where("NOT win RLIKE '[BJOXZU]'")
    b = w.groupBy(F.substring("win", 1, 1).alias("first"), F.substring("win", 5, 1).alias("last"))
    return b.agg(F.count("*").alias("hits"), F.countDistinct("p_partkey").alias("proteins"))


@query("""
WITH m AS (SELECT l_partkey AS feature, l_returnflag AS cond, l_linenumber AS rep, sum(l_extendedprice) AS q FROM lineitem GROUP BY 1, 2, 3),
r AS (SELECT feature, cond, avg(q) AS q FROM m GROUP BY 1, 2)
SELECT feature, cond, round(log2(q), 4) AS mean_log FROM r WHERE q > 0""")
def a14_group_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("feature"), F.col("l_returnflag").alias("cond"), "l_linenumber").agg(F.sum("l_extendedprice").alias("q"))
    r = m.groupBy("feature", "cond").agg(F.avg("q").alias("q")).where("q > 0")
    return r.select("feature", "cond", F.round(F.log2("q"), 4).alias("mean_log"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def d25_top_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_totalprice > 100000")
    return o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice")

