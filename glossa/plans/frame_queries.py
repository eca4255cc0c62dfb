"""Catalogue queries of the probabilities of frames, over the star-schema tables: suppliers stand for predicates, parts for
frames, the flags and modes of lines for slots. Each with the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import probability as pr
from glossa.plans.session import table


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("predicate"), F.col("l_partkey").alias("frame"), F.col("l_returnflag").alias("slot"), F.month("l_shipdate").cast("long").alias("mode"), "l_orderkey")


def _rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.round("log_p", 6).alias("log_p"))


def frame_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _lines(spark, sf_dir).groupBy("predicate", "frame").agg(F.count("*").alias("n"))
    return _rounded(pr.frame_log(counts), "predicate", "frame")


def case_count_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many different slots the lines of a frame in an order have."""
    per = _lines(spark, sf_dir).groupBy("predicate", "frame", "l_orderkey").agg(F.count_distinct("slot").alias("n"))
    by_frame = per.groupBy("frame", "n").agg(F.count("*").alias("k")).where("k > 1")
    by_predicate = per.groupBy("predicate", "n").agg(F.count("*").alias("k"))
    total = per.groupBy("predicate").agg(F.count("*").alias("d"))
    share = by_predicate.join(total, "predicate").select("predicate", "n", (F.col("k") / F.col("d")).alias("p"))
    asked = per.select("predicate", "frame").distinct().select("predicate", "frame", F.explode(F.array(*[F.lit(i).cast("long") for i in (1, 2, 3)])).alias("n"))
    return _rounded(pr.case_count_log(asked, by_frame, share), "predicate", "frame", "n")


def case_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    shares = lambda by: lines.groupBy(by, "slot").agg(F.count("*").alias("k")).join(lines.groupBy(by).agg(F.count("*").alias("d")), by)
    by_predicate = shares("predicate").select("predicate", "slot", (F.col("k") / F.col("d")).alias("p"))
    frames = lines.select("predicate", "frame").distinct().select("predicate", "frame", F.explode(F.array(*map(F.lit, "ANR"))).alias("slot"))
    asked = frames.select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("filled"))
    return _rounded(pr.case_log(asked, shares("frame"), by_predicate), "predicate", "frame", "slot", "filled")


def example_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of a line's own key, its predicate's and its mode's, each a share of returned lines with at least five lines."""
    lines = _lines(spark, sf_dir)
    own, general, kind = F.concat_ws("|", "frame", "mode"), F.concat_ws("|", F.lit("*"), "frame"), F.concat_ws("|", F.lit("mode"), "mode")
    shares = [lines.groupBy(k.alias("key")).agg(F.count("*").alias("d"), F.count_if(F.col("slot") == "R").alias("k")).where("d >= 5") for k in (own, general, kind)]
    known = shares[0].unionByName(shares[1]).unionByName(shares[2]).select("key", (F.col("k") / F.col("d")).alias("p")).where("p > 0.3")
    asked = lines.select("frame", "mode").distinct()
    return _rounded(pr.best_log(asked, known, [own, general, kind], "log_p"), "frame", "mode")


def category_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by the words of their type: P(part | word) P(word | brand)."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("word"), F.col("p_brand").alias("slot"), F.split("p_type", " ").alias("categories"))
    each = part.select("word", "slot", F.explode("categories").alias("category"))
    total = each.groupBy("category").agg(F.count("*").alias("d"))
    words = each.join(total, "category").select("word", "category", (1 / F.col("d")).alias("p"))
    of_slot = each.groupBy("slot").agg(F.count("*").alias("d"))
    slots = each.groupBy("slot", "category").agg(F.count("*").alias("k")).join(of_slot, "slot").select("slot", "category", (F.col("k") / F.col("d")).alias("p"))
    return pr.category_backoff(part, words, slots, ["word"]).select("word", F.round("p", 9).alias("p"))


def slot_backoff_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P(returned | supplier and mode), else | supplier, else | mode: the keyed look-ups of clauses, topics and the like."""
    lines = _lines(spark, sf_dir).withColumns({"any": F.lit("*")})
    levels = [["predicate", "mode"], ["predicate"], ["any", "mode"]]
    tables = []
    for level, least in zip(levels, (8, 60, 0), strict=True):
        key = F.concat_ws("|", *[F.col(c).cast("string") for c in level])
        tables.append(lines.groupBy(key.alias("key")).agg(F.count("*").alias("d"), F.count_if(F.col("slot") == "R").alias("k")).where(f"d >= {least}").select("key", (F.col("k") / F.col("d")).alias("p")))
    known = tables[0].unionByName(tables[1]).unionByName(tables[2])
    found = pr.backoff_log(lines.select("predicate", "mode", "any").distinct(), known, levels, "log_p")
    return found.select("predicate", "mode", F.round("log_p", 6).alias("log_p"), F.col("level").cast("long").alias("level"))


def frame_pair_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one order as frames, with a table that has pairs of one brand."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    a, b = lines.alias("a"), lines.alias("b")
    pairs = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("b.l_linenumber") == F.col("a.l_linenumber") + 1)).select(F.col("a.l_partkey").alias("x"), F.col("b.l_partkey").alias("y"))
    x, y = part.alias("x"), part.alias("y")
    low, high = F.least("x", "y"), F.greatest("x", "y")
    known = (
        pairs.select(low.alias("i"), high.alias("j")).distinct().where("i < j")
        .join(x, F.col("i") == F.col("x.p_partkey")).join(y, F.col("j") == F.col("y.p_partkey")).where("x.p_brand = y.p_brand")
        .select(F.concat(F.lit("part"), "i", F.lit("-part"), "j").alias("key"), (1 / (1 + F.abs(F.col("x.p_size") - F.col("y.p_size")))).alias("sim"))
    )
    named = pairs.select(F.concat(F.lit("part"), "x").alias("a"), F.concat(F.lit("part"), "y").alias("b"))
    found = pr.frame_similarity(named, known).groupBy(F.round("similarity", 6).alias("similarity")).agg(F.count("*").alias("n"))
    return found


#: (frame, probability, slots (case, filled, obligatory, adjacent, words, counts)) of the one predicate of frame_assign.
FRAMES = [
    ("eat1", 0.6, [("ga", 0.5, False, False, ["A", "N"], [3.0, 1.0]), ("wo", 0.4, False, False, ["R", "A"], [2.0, 2.0])]),
    ("eat2", 0.3, [("ga", 0.9, False, False, ["R"], [1.0]), ("wo", 0.2, False, False, ["N", "*"], [1.0, 1.0])]),
    ("eat3", 0.1, [("ga", 0.3, False, False, ["A"], [1.0]), ("wo", 0.6, True, True, ["N"], [2.0])]),
]


def frame_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two lines of an order as a predicate's elements, by case ga, and ga or wo: all frames ranked by their best assignment."""
    from glossa.operators.frames import FRAMES as TYPE
    from glossa.operators.frames import assign_frames

    def element(n: int, *cases: str) -> Column:
        its = F.col("l_linenumber") == n
        word = F.max(F.when(its, F.col("l_returnflag"))).alias("word")
        return F.when(F.count_if(its) > 0, F.struct(word, F.array(*map(F.lit, cases)).alias("cases"), F.lit(False).alias("adjacent")))

    lines = table(spark, sf_dir, "lineitem").where("l_linenumber IN (1, 2)").groupBy("l_orderkey")
    orders = lines.agg(F.filter(F.array(element(1, "ga"), element(2, "ga", "wo")), lambda x: x.isNotNull()).alias("elements"))
    known = spark.createDataFrame([(FRAMES,)], f"frames {TYPE}")
    rows = orders.join(F.broadcast(known))  # one row
    found = assign_frames(rows, ["l_orderkey"], 3)
    return found.select("l_orderkey", F.col("rank").cast("long").alias("rank"), "frame_id", F.round("score", 6).alias("score"))


def frame_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as predicates, frames known by clerk's nearest element, by priority and status, by priority, and for all."""
    from glossa.operators.frames import lookup_frames

    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).alias("predicate"), F.col("o_orderstatus").alias("voice"), (F.col("o_custkey") % 10).cast("string").alias("nearest"))
    known = [("n", "3:1", "O"), ("pv", "1", "F"), ("pv2", "1", "O"), ("p", "2", "x"), ("p2", "2", "y"), ("d", "*", "x")]
    found = lookup_frames(orders, spark.createDataFrame(known, "frame_id string, predicate string, voice string"))
    return found.groupBy("predicate", "voice", "f_frame_id").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (frame_prob, case_count_prob, case_prob, example_prob, category_prob, slot_backoff_prob, frame_pair_similarity, frame_assign, frame_lookup)}

LINES = "lines AS (SELECT l_suppkey AS predicate, l_partkey AS frame, l_returnflag AS slot, month(l_shipdate) AS mode, l_orderkey FROM lineitem)"

ORACLES = {
    "frame_prob": f"""
        WITH {LINES}, counts AS (SELECT predicate, frame, count(*) AS n FROM lines GROUP BY ALL)
        SELECT predicate, frame, round(ln(n / sum(n) OVER (PARTITION BY predicate)), 6) AS log_p FROM counts""",
    "case_count_prob": f"""
        WITH {LINES}, per AS (SELECT predicate, frame, l_orderkey, count(DISTINCT slot) AS n FROM lines GROUP BY ALL),
        f AS (SELECT frame, n, count(*) AS k FROM per GROUP BY ALL HAVING count(*) > 1),
        d AS (SELECT frame, sum(k) AS d FROM f GROUP BY frame),
        q AS (SELECT predicate, n, count(*) / sum(count(*)) OVER (PARTITION BY predicate) AS p FROM per GROUP BY predicate, n),
        asked AS (SELECT DISTINCT predicate, frame, unnest([1, 2, 3])::BIGINT AS n FROM per),
        mixed AS (
            SELECT a.predicate, a.frame, a.n, coalesce(d.d, 0) / (coalesce(d.d, 0) + 1) * coalesce(f.k / d.d, 0) + (1 - coalesce(d.d, 0) / (coalesce(d.d, 0) + 1)) * coalesce(q.p, 0) AS p
            FROM asked a LEFT JOIN d USING (frame) LEFT JOIN f ON f.frame = a.frame AND f.n = a.n LEFT JOIN q ON q.predicate = a.predicate AND q.n = a.n
        )
        SELECT predicate, frame, n, round(CASE WHEN p > 0 THEN ln(p) ELSE ln(1e-5) END, 6) AS log_p FROM mixed""",
    "case_prob": f"""
        WITH {LINES}, f AS (SELECT frame, slot, count(*) AS k FROM lines GROUP BY ALL), d AS (SELECT frame, count(*) AS d FROM lines GROUP BY frame),
        q AS (SELECT predicate, slot, count(*) / sum(count(*)) OVER (PARTITION BY predicate) AS p FROM lines GROUP BY predicate, slot),
        asked AS (SELECT DISTINCT predicate, frame, unnest(['A', 'N', 'R']) AS slot FROM lines),
        both_ AS (SELECT *, unnest([true, false]) AS filled FROM asked),
        mixed AS (
            SELECT a.*, CASE WHEN f.k IS NULL THEN coalesce(q.p, 0) ELSE d.d / (d.d + 1) * (f.k / d.d) + (1 - d.d / (d.d + 1)) * coalesce(q.p, 0) END AS p
            FROM both_ a LEFT JOIN f USING (frame, slot) LEFT JOIN d ON d.frame = a.frame LEFT JOIN q ON q.predicate = a.predicate AND q.slot = a.slot
        )
        SELECT predicate, frame, slot, filled,
            round(CASE WHEN filled THEN (CASE WHEN p > 0 THEN ln(p) ELSE ln(1e-5) END) WHEN 1 - p > 0 THEN ln(1 - p) ELSE ln(1e-6) END, 6) AS log_p FROM mixed""",
    "example_prob": f"""
        WITH {LINES}, own AS (SELECT frame, mode, count(*) FILTER (slot = 'R') / count(*) AS p FROM lines GROUP BY ALL HAVING count(*) >= 5),
        general AS (SELECT frame, count(*) FILTER (slot = 'R') / count(*) AS p FROM lines GROUP BY ALL HAVING count(*) >= 5),
        kind AS (SELECT mode, count(*) FILTER (slot = 'R') / count(*) AS p FROM lines GROUP BY ALL HAVING count(*) >= 5),
        asked AS (SELECT DISTINCT frame, mode FROM lines),
        best AS (
            SELECT a.frame, a.mode, greatest(CASE WHEN o.p > 0.3 THEN o.p ELSE 0 END, CASE WHEN g.p > 0.3 THEN g.p ELSE 0 END, CASE WHEN k.p > 0.3 THEN k.p ELSE 0 END) AS p
            FROM asked a LEFT JOIN own o USING (frame, mode) LEFT JOIN general g ON g.frame = a.frame LEFT JOIN kind k ON k.mode = a.mode
        )
        SELECT frame, mode, round(CASE WHEN p > 0 THEN ln(p) ELSE ln(1e-6) END, 6) AS log_p FROM best""",
    "category_prob": """
        WITH each_ AS (SELECT p_partkey AS word, p_brand AS slot, unnest(string_split(p_type, ' ')) AS category FROM part),
        d AS (SELECT category, count(*) AS d FROM each_ GROUP BY category),
        s AS (SELECT slot, category, count(*) / sum(count(*)) OVER (PARTITION BY slot) AS p FROM each_ GROUP BY slot, category)
        SELECT word, round(max(s.p / d.d), 9) AS p FROM each_ e JOIN d USING (category) JOIN s ON s.slot = e.slot AND s.category = e.category GROUP BY word""",
    "slot_backoff_prob": f"""
        WITH {LINES}, a AS (SELECT predicate, mode, count(*) FILTER (slot = 'R') / count(*) AS p FROM lines GROUP BY ALL HAVING count(*) >= 8),
        b AS (SELECT predicate, count(*) FILTER (slot = 'R') / count(*) AS p FROM lines GROUP BY ALL HAVING count(*) >= 60),
        c AS (SELECT mode, count(*) FILTER (slot = 'R') / count(*) AS p FROM lines GROUP BY ALL),
        asked AS (SELECT DISTINCT predicate, mode FROM lines),
        found AS (
            SELECT x.predicate, x.mode, coalesce(a.p, b.p, c.p) AS p, CASE WHEN a.p IS NOT NULL THEN 1 WHEN b.p IS NOT NULL THEN 2 ELSE 3 END AS level
            FROM asked x LEFT JOIN a USING (predicate, mode) LEFT JOIN b ON b.predicate = x.predicate LEFT JOIN c ON c.mode = x.mode
        )
        SELECT predicate, mode, round(CASE WHEN p > 0 THEN ln(p) ELSE ln(1e-6) END, 6) AS log_p, CAST(level AS BIGINT) AS level FROM found""",
    "frame_assign": """
        WITH o AS (SELECT l_orderkey, max(CASE WHEN l_linenumber = 1 THEN l_returnflag END) AS w1, max(CASE WHEN l_linenumber = 2 THEN l_returnflag END) AS w2 FROM lineitem WHERE l_linenumber IN (1, 2) GROUP BY l_orderkey),
        f(frame_id, no, p, g, w, pen) AS (VALUES ('eat1', 1, 0.6, 0.5, 0.4, 0), ('eat2', 2, 0.3, 0.9, 0.2, 0), ('eat3', 3, 0.1, 0.3, 0.6, -500)),
        ex(frame_id, slot, word, q) AS (VALUES ('eat1', 0, 'A', 0.75), ('eat1', 0, 'N', 0.25), ('eat1', 1, 'R', 0.5), ('eat1', 1, 'A', 0.5), ('eat2', 0, 'R', 1.0), ('eat2', 1, 'N', 0.5), ('eat2', 1, 'A', 0.5), ('eat2', 1, 'R', 0.5), ('eat3', 0, 'A', 1.0), ('eat3', 1, 'N', 1.0)),
        c(s1, s2) AS (VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1)),
        scored AS (
            SELECT l_orderkey, f.frame_id, no, (s1 >= 0)::INT + (s2 >= 0)::INT AS assigned,
                ln(p) + CASE WHEN w1 IS NULL THEN 0 WHEN s1 = -1 THEN -20 ELSE ln(coalesce(a.q, 1e-6)) + ln(g) END
                + CASE WHEN w2 IS NULL THEN 0 WHEN s2 = -1 THEN -20 WHEN s2 = 0 THEN ln(coalesce(b.q, 1e-6)) + ln(g) ELSE ln(coalesce(b.q, 1e-6)) + ln(w) END
                + CASE WHEN s1 = 0 OR s2 = 0 THEN 0 ELSE ln(1 - g) END + CASE WHEN s2 = 1 THEN 0 ELSE ln(1 - w) + pen END AS score
            FROM o CROSS JOIN f CROSS JOIN c LEFT JOIN ex a ON a.frame_id = f.frame_id AND a.slot = s1 AND a.word = w1 LEFT JOIN ex b ON b.frame_id = f.frame_id AND b.slot = s2 AND b.word = w2
            WHERE (w1 IS NOT NULL OR s1 = -1) AND (w2 IS NOT NULL OR s2 = -1)
        ),
        best AS (SELECT l_orderkey, frame_id, no, max(score) AS score FROM scored GROUP BY ALL)
        SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY round(score, 9) DESC, no) AS rank, frame_id, round(score, 6) AS score FROM best""",
    "frame_lookup": """
        WITH o AS (SELECT substr(o_orderpriority, 1, 1) AS predicate, o_orderstatus AS voice, o_custkey % 10 AS nearest FROM orders),
        l AS (
            SELECT predicate, voice, unnest(CASE WHEN nearest = 3 AND predicate = '1' AND voice = 'O' THEN ['n'] WHEN predicate = '1' AND voice = 'F' THEN ['pv'] WHEN predicate = '1' AND voice = 'O' THEN ['pv2']
                WHEN predicate = '1' THEN ['pv', 'pv2'] WHEN predicate = '2' THEN ['p', 'p2'] ELSE ['d'] END) AS f_frame_id FROM o
        )
        SELECT predicate, voice, f_frame_id, count(*) AS n FROM l GROUP BY ALL""",
    "frame_pair_similarity": """
        WITH pairs AS (SELECT a.l_partkey AS x, b.l_partkey AS y FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1),
        found AS (
            SELECT CASE WHEN x = y THEN 1.0 WHEN p.p_brand = q.p_brand THEN 1 / (1 + abs(p.p_size - q.p_size)) ELSE 0.0 END AS similarity
            FROM pairs JOIN part p ON p.p_partkey = x JOIN part q ON q.p_partkey = y
        )
        SELECT round(similarity, 6)::DOUBLE AS similarity, count(*) AS n FROM found GROUP BY ALL""",
}
