"""Catalogue queries over the star-schema tables and events, each with the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.functions import features
from glossa.functions.probability import backoff, floored_log, interpolated
from glossa.functions.similarity import code_similarity
from glossa.operators import dependency, structure
from glossa.operators.frames import top_k
from glossa.plans.session import table
from glossa.sources import kv


def feature_dnf_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.array(F.concat(F.lit("brand:"), "p_brand"), F.concat(F.lit("size:"), F.col("p_size").cast("string")), F.when(F.col("p_retailprice") > 1200, "dear").otherwise("cheap"))
    part = table(spark, sf_dir, "part").withColumn("f", own)
    pattern = [["dear", "^size:10"], ["cheap", "size:20"]]
    out = part.where(features.dnf(F.col("f"), pattern))
    return out.select("p_partkey", features.value(F.col("f"), "brand").alias("brand"), F.array_join(features.put(F.col("f"), "size:0"), ",").alias("features"))


def rule_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("urgent", F.col("o_orderpriority").startswith("1")), ("large", F.col("o_totalprice") > 300000), ("open", F.col("o_orderstatus") == "O")]
    found = table(spark, sf_dir, "orders").withColumn("rule", dependency.first_rule(None, rules))
    return found.groupBy("rule", "o_orderstatus").agg(F.count("*").alias("n"))


def feature_propagate(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    out = table(spark, sf_dir, "events").withColumns({"before": F.lag("event_type").over(w), "after2": F.lead("event_type", 2).over(w)})
    return out.select("event_id", "before", "after2")


def run_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = structure.merge_runs(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type"))
    return merged.groupBy("user_id", "run").agg(F.count("*").alias("n"), F.min("event_id").alias("least_event"), F.min("event_type").alias("event_type")).select("user_id", "run", "n", "least_event", "event_type")


def interval_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of one to four events of a user, each with the three that begin next, by user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ends = F.element_at(F.array(*[F.lead("ts", k).over(w) for k in (1, 2, 3, 4)]), (F.col("event_id") % 4 + 1).cast("int"))
    spans = table(spark, sf_dir, "events").withColumn("till", ends)
    near = F.array(*[F.struct(F.lead("ts", k).over(w).alias("b1"), F.lead("till", k).over(w).alias("b2")) for k in (1, 2, 3)])
    pairs = spans.withColumn("near", near).select("user_id", "ts", "till", F.inline_outer("near")).where("till IS NOT NULL AND b2 IS NOT NULL")
    relation = dependency.interval_relation(F.col("ts"), F.col("till"), F.col("b1"), F.col("b2"))
    return pairs.groupBy("user_id", relation.alias("relation")).agg(F.count("*").alias("n"))


def prefix_code_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders in turn, by their date as a path of year, month and day."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    path = F.split(F.col("o_orderdate").cast("date").cast("string"), "-")
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", path.alias("path")).withColumn("before", F.lag("path").over(w)).where("before IS NOT NULL")
    return orders.select("o_orderkey", F.round(code_similarity(F.col("before"), F.col("path")), 6).alias("similarity"))


def case_prob_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    joined = line.join(part, "l_partkey")
    by_part = joined.groupBy("l_partkey", "p_brand").agg(F.count("*").alias("d"), F.count_if(F.col("l_returnflag") == "R").alias("k"))
    by_brand = joined.groupBy("p_brand").agg(F.count("*").alias("db"), F.count_if(F.col("l_returnflag") == "R").alias("kb"))
    p = interpolated(F.col("k") / F.col("d"), F.col("d"), F.col("kb") / F.col("db"))
    return by_part.join(by_brand, "p_brand").select("l_partkey", F.round(p, 6).alias("p"))


def example_prob_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    n = line.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if((F.col("l_returnflag") == "A") & (F.col("l_quantity") > 45)).alias("k"))
    return n.select("l_suppkey", F.round(floored_log(F.col("k") / F.col("n")), 6).alias("log_p"))


def event_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumns({"hour": F.hour("ts"), "any": F.lit("*")})
    keys = [["user_id", "event_type", "hour"], ["user_id", "event_type"], ["event_type"], ["any"]]
    counted = [events.groupBy(F.concat_ws("|", *[F.col(c).cast("string") for c in k]).alias("key")).agg(F.count("*").alias("score")).where(f"score >= {least}") for k, least in zip(keys, (3, 8, 20, 0), strict=True)]
    known = counted[0]
    for c in counted[1:]:
        known = known.unionByName(c)
    found = backoff(events.select("event_id", "user_id", "event_type", "hour", "any"), known, keys, "score")
    return found.select("event_id", "score", F.col("level").cast("long").alias("level"))


def topk_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("quantity"))
    return top_k(q, ["l_suppkey"], [F.desc("quantity"), F.col("l_partkey")], 5).select("l_suppkey", "l_partkey", "quantity", F.col("rank").cast("long").alias("rank"))


def _urgencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, value): for each order of a customer a vector of five places, 1 at its priority."""
    at = F.substring("o_orderpriority", 1, 1).cast("int")
    vector = F.concat(F.repeat(F.lit("0"), at - 1), F.lit("1"), F.repeat(F.lit("0"), 5 - at))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), vector.alias("value"))


def kv_merge_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("value"), "o_orderkey")
    return kv.bulk_load(rows, "append", "o_orderkey")


def kv_merge_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.bulk_load(_urgencies(spark, sf_dir), "or")


def kv_merge_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.bulk_load(_urgencies(spark, sf_dir), "and")


def kv_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last status of each order's customer, by a table of one row for each key."""
    orders = table(spark, sf_dir, "orders")
    known = kv.bulk_load(orders.where("o_totalprice > 100000").select(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("value"), "o_orderkey"), "last", "o_orderkey")
    found = kv.look_up(orders.select("o_orderkey", F.col("o_custkey").alias("key")), known)
    return found.groupBy("key", "value").agg(F.count("*").alias("n"))


def reference_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.operators.discourse import salience

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("step", F.row_number().over(w).cast("long")).withColumn("one", F.lit(1.0))
    scored = salience(rows.select("user_id", "step", "event_type", "one", "event_id"), "user_id", "step", "event_type", "one")
    return scored.select("event_id", F.round("salience", 6).alias("references"))


QUERIES = {
    f.__name__: f
    for f in (
        feature_dnf_filter, rule_first_match, feature_propagate, run_merge, interval_relations, prefix_code_similarity, case_prob_interp, example_prob_floor,
        event_backoff, topk_frames, kv_merge_append, kv_merge_or, kv_merge_and, kv_lookup, reference_decay,
    )
}



def _bits(fold: str) -> str:
    place = " || ".join(f"CAST({fold}(CASE WHEN o_orderpriority LIKE '{i}%' THEN 1 ELSE 0 END) AS VARCHAR)" for i in range(1, 6))
    return f"SELECT o_custkey AS key, {place} AS value FROM orders GROUP BY o_custkey"


ORACLES = {
    "feature_dnf_filter": """
        SELECT p_partkey, p_brand AS brand, concat('brand:', p_brand, ',size:0,', CASE WHEN p_retailprice > 1200 THEN 'dear' ELSE 'cheap' END) AS features
        FROM part WHERE (p_retailprice > 1200 AND p_size <> 10) OR (NOT p_retailprice > 1200 AND p_size = 20)""",
    "rule_first_match": """
        SELECT CASE WHEN o_orderpriority LIKE '1%' THEN 'urgent' WHEN o_totalprice > 300000 THEN 'large' WHEN o_orderstatus = 'O' THEN 'open' ELSE 'default' END AS rule, o_orderstatus, count(*) AS n
        FROM orders GROUP BY ALL""",
    "feature_propagate": """
        SELECT event_id, lag(event_type) OVER w AS before, lead(event_type, 2) OVER w AS after2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "run_merge": """
        WITH marked AS (
            SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 0 ELSE 1 END AS new FROM events
        ),
        runs AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS run FROM marked)
        SELECT user_id, run, count(*) AS n, min(event_id) AS least_event, min(event_type) AS event_type FROM runs GROUP BY user_id, run""",
    "interval_relations": """
        WITH a AS (
            SELECT *, CASE event_id % 4 WHEN 0 THEN lead(ts, 1) OVER w WHEN 1 THEN lead(ts, 2) OVER w WHEN 2 THEN lead(ts, 3) OVER w ELSE lead(ts, 4) OVER w END AS till
            FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
        ),
        b AS (
            SELECT user_id, ts, till, unnest([lead(ts, 1) OVER w, lead(ts, 2) OVER w, lead(ts, 3) OVER w]) AS b1, unnest([lead(till, 1) OVER w, lead(till, 2) OVER w, lead(till, 3) OVER w]) AS b2
            FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
        )
        SELECT user_id, CASE WHEN till < b1 THEN 'before' WHEN till = b1 THEN 'meets' WHEN ts = b1 AND till = b2 THEN 'equal' WHEN ts = b1 THEN 'starts' WHEN till = b2 THEN 'ends'
            WHEN ts < b1 AND till > b2 THEN 'contains' WHEN ts > b1 AND till < b2 THEN 'inside' WHEN ts < b1 AND till < b2 THEN 'overlaps' ELSE 'after' END AS relation, count(*) AS n
        FROM b WHERE till IS NOT NULL AND b2 IS NOT NULL GROUP BY ALL""",
    "prefix_code_similarity": """
        WITH o AS (
            SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d, lag(CAST(CAST(o_orderdate AS DATE) AS VARCHAR)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders
        )
        SELECT o_orderkey, round(CASE WHEN d = p THEN 1 WHEN substr(d, 1, 7) = substr(p, 1, 7) THEN 2 / 3 WHEN substr(d, 1, 4) = substr(p, 1, 4) THEN 1 / 3 ELSE 0 END, 6)::DOUBLE AS similarity
        FROM o WHERE p IS NOT NULL""",
    "case_prob_interp": """
        WITH j AS (SELECT l_partkey, p_brand, l_returnflag = 'R' AS r FROM lineitem JOIN part ON p_partkey = l_partkey),
        a AS (SELECT l_partkey, p_brand, count(*) AS d, count(*) FILTER (r) AS k FROM j GROUP BY ALL),
        b AS (SELECT p_brand, count(*) AS db, count(*) FILTER (r) AS kb FROM j GROUP BY ALL)
        SELECT l_partkey, round(d / (d + 1) * (k / d) + (1 - d / (d + 1)) * (kb / db), 6) AS p FROM a JOIN b USING (p_brand)""",
    "example_prob_floor": """
        WITH n AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_returnflag = 'A' AND l_quantity > 45) AS k FROM lineitem GROUP BY ALL)
        SELECT l_suppkey, round(CASE WHEN k > 0 THEN ln(k / n) ELSE ln(1e-6) END, 6) AS log_p FROM n""",
    "event_backoff": """
        WITH e AS (SELECT *, hour(ts) AS h FROM events),
        a AS (SELECT user_id, event_type, h, count(*) AS s FROM e GROUP BY ALL HAVING count(*) >= 3),
        b AS (SELECT user_id, event_type, count(*) AS s FROM e GROUP BY ALL HAVING count(*) >= 8),
        c AS (SELECT event_type, count(*) AS s FROM e GROUP BY ALL HAVING count(*) >= 20)
        SELECT e.event_id, coalesce(a.s, b.s, c.s, (SELECT count(*) FROM e)) AS score,
            CAST(CASE WHEN a.s IS NOT NULL THEN 1 WHEN b.s IS NOT NULL THEN 2 WHEN c.s IS NOT NULL THEN 3 ELSE 4 END AS BIGINT) AS level
        FROM e LEFT JOIN a ON a.user_id = e.user_id AND a.event_type = e.event_type AND a.h = e.h
            LEFT JOIN b ON b.user_id = e.user_id AND b.event_type = e.event_type LEFT JOIN c ON c.event_type = e.event_type""",
    "topk_frames": """
        WITH q AS (SELECT l_suppkey, l_partkey, sum(l_quantity) AS quantity FROM lineitem GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY quantity DESC, l_partkey) AS rank FROM q)
        SELECT l_suppkey, l_partkey, quantity, rank FROM r WHERE rank <= 5""",
    "kv_merge_append": "SELECT o_custkey AS key, string_agg(o_orderstatus, '/' ORDER BY o_orderkey, o_orderstatus) AS value FROM orders GROUP BY o_custkey",
    "kv_merge_or": _bits("max"),
    "kv_merge_and": _bits("min"),
    "kv_lookup": """
        WITH t AS (SELECT o_custkey AS key, arg_max(o_orderstatus, o_orderkey) AS value FROM orders WHERE o_totalprice > 100000 GROUP BY o_custkey)
        SELECT o_custkey AS key, value, count(*) AS n FROM orders LEFT JOIN t ON t.key = o_custkey GROUP BY ALL""",
    "reference_decay": """
        WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events)
        SELECT a.event_id, round(sum(pow(0.5, a.step - b.step)), 6) AS "references"
        FROM r a JOIN r b ON a.user_id = b.user_id AND a.event_type = b.event_type AND b.step <= a.step GROUP BY a.event_id""",
}
