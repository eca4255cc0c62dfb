"""Catalogue queries of column functions, masks and sinks over the star-schema tables and documents, each with the same in
DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.functions import chars, features, morphology
from glossa.functions.probability import class_probability
from glossa.operators import dependency, discourse, entities, structure
from glossa.operators.structure import sentences, tokens
from glossa.plans.session import table
from glossa.plans.text_queries import TOKENS
from glossa.sources import sinks

KANA = "あいうえおかきくけこ"
HIRAGANA, KATAKANA = "".join(map(chr, range(0x3041, 0x3097))), "".join(map(chr, range(0x30A1, 0x30F7)))
HALF, FULL = "".join(map(chr, range(0x21, 0x7F))) + " ", "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"


def _long(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c, t in df.dtypes if t == "int"})


def kana_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part keys spelt in kana, and types in full width and back."""
    kana = F.translate(F.col("p_partkey").cast("string"), "0123456789", KANA)
    part = table(spark, sf_dir, "part").select("p_partkey", kana.alias("hiragana"), "p_type")
    full = chars.to_full_width(F.col("p_type"))
    return part.select("p_partkey", chars.to_katakana(F.col("hiragana")).alias("katakana"), chars.to_hiragana(chars.to_katakana(F.col("hiragana"))).alias("hiragana"), full.alias("wide"), chars.to_half_width(full).alias("narrow"))


def affix_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the types of a part and the one before it share at the start and at the end."""
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    pairs = table(spark, sf_dir, "part").withColumn("before", F.lag("p_type").over(w)).where("before IS NOT NULL")
    return _long(pairs.select("p_partkey", chars.common_prefix(F.col("before"), F.col("p_type")).alias("prefix"), chars.common_suffix(F.col("before"), F.col("p_type")).alias("suffix")))


def word_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of documents by the class of all their characters, their end and their length."""
    toks = sentences(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.explode(tokens(F.col("sentence"))).alias("t"))
    t = F.col("t")
    found = toks.select(chars.char_class(t).alias("class"), chars.ends_in(t, "symbol").alias("ends_in_symbol"), chars.is_single(t).alias("single"))
    return found.groupBy("class", "ends_in_symbol", "single").agg(F.count("*").alias("n"))


def feature_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.array(F.concat(F.lit("brand:"), "p_brand"), F.lit("T-mark"), F.concat(F.lit("size:"), F.col("p_size").cast("string"), F.lit(":cm")), F.lit("brandy"))
    part = table(spark, sf_dir, "part").withColumn("f", own)
    less = features.drop(features.drop_temporary(F.col("f")), "brand")
    return part.select("p_partkey", F.array_join(less, ",").alias("kept"), features.without_last_field(F.get("f", 2)).alias("field"), features.has(less, "brand").alias("has_brand"))


def canonical_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("ws", F.split("p_type", " "))
    forms = F.transform("ws", lambda w: F.when(F.length(w) > 3, morphology.canonical(w, F.lower(w))))
    return part.select("p_partkey", morphology.joined_canonical(forms).alias("form"))


def predicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as predicates: priority and status give voices, a copula and negation."""
    first = F.substring("o_orderpriority", 1, 1)
    voice = F.when(first == "1", "voice:passive").when(first == "2", "voice:passive&causative").when(first == "3", "voice:desiderative&benefactive")
    own = F.filter(F.array(voice, F.when(F.col("o_orderstatus") == "O", "copula"), F.when(F.col("o_totalprice") > 200000, "negation")), lambda x: x.isNotNull())
    orders = table(spark, sf_dir, "orders").withColumn("f", own)
    keys = orders.select(morphology.predicate_key(F.lower("o_orderstatus"), F.lit("verb"), F.col("f")).alias("key"), morphology.voice_flags(F.col("f")).cast("long").alias("voices"))
    return keys.groupBy("key", "voices").agg(F.count("*").alias("n"))


def case_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases of a part's lines as vectors, of all of them and of those of the first supplier."""
    name = lambda c: F.when(c == "A", "ga").when(c == "N", "を").otherwise("ni")
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", name(F.col("l_returnflag")).alias("case"), (F.col("l_suppkey") % 2 == 0).alias("even"))
    sets = lines.groupBy("l_partkey").agg(F.collect_set("case").alias("all"), F.collect_set(F.when(F.col("even"), F.col("case"))).alias("some"))  # of three values
    a, b = morphology.case_vector(F.col("all")), morphology.case_vector(F.col("some"))
    text = lambda v: F.array_join(F.transform(v, lambda x: x.cast("string")), "")
    least = F.array_min(F.transform("all", morphology.case_code))
    return sets.select("l_partkey", text(morphology.or_vectors(a, b)).alias("either"), text(morphology.and_vectors(a, b)).alias("both"), morphology.case_name(least).alias("first_case"))


def inflected_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = [("ing", "base", "ING"), ("ing", "past", "ED"), ("ed", "base", "ED"), ("ed", "past", "ING"), ("steel", "base", "L")]
    endings = spark.createDataFrame(ends, "kind string, form string, ending string")
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_type", " ")).alias("word")).distinct()
    kind = F.when(F.col("word").endswith("ED"), "ed").when(F.col("word").endswith("L"), "steel").otherwise("ing")
    return morphology.inflected(words.withColumn("kind", kind), endings, "past").select("word", "inflected")


def suffix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types' words, leading ones dropped until the rest is the type of a part of brand 13 or one word of a type."""
    part = table(spark, sf_dir, "part")
    last = part.select(F.element_at(F.split("p_type", " "), -1).alias("key")).distinct().withColumn("value", F.lit("word"))
    whole = part.where("p_brand = 'Brand#13'").select(F.replace("p_type", F.lit(" "), F.lit("")).alias("key")).distinct().withColumn("value", F.lit("type"))
    known = last.unionByName(whole).groupBy("key").agg(F.max("value").alias("value"))
    return morphology.longest_suffix(part.select("p_partkey", F.split("p_type", " ").alias("ws")), known, "ws", "found").select("p_partkey", "found")


def event_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much likelier two kinds of event follow each other than by chance, its bin and a margin's probability."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pairs = table(spark, sf_dir, "events").select(F.col("event_type").alias("a"), F.lead("event_type").over(w).alias("b")).where("b IS NOT NULL")
    both = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    counted = both.withColumns({"na": F.sum("n").over(Window.partitionBy("a")), "nb": F.sum("n").over(Window.partitionBy("b"))}).join(F.broadcast(both.agg(F.sum("n").alias("t"))))
    share = lambda c: F.col(c) / F.col("t")
    lift = morphology.lift(share("n"), share("na"), share("nb"))
    return counted.select(
        "a", "b", F.round(lift, 6).alias("lift"), F.round(morphology.margin_probability(lift - 1), 6).alias("p"), morphology.binned(F.least(lift / 2, F.lit(1.0))).cast("long").alias("bin")
    )


def class_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P(part | brand) through the words of types as classes."""
    each = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.explode(F.split("p_type", " ")).alias("c"))
    of = lambda *by: F.count("*").over(Window.partitionBy(*by))
    total = F.broadcast(each.agg(F.count("*").alias("t")))
    rows = each.withColumns({"nc": of("c"), "nbc": of("p_brand", "c"), "nb": of("p_brand")}).join(total)
    shares = rows.select("p_partkey", "p_brand", (F.col("nbc") / F.col("nb")).alias("p_class_slot"), (F.col("nc") / F.col("t")).alias("p_class"), (1 / F.col("nc")).alias("p_word_class"))
    return class_probability(shares, ["p_partkey", "p_brand"]).withColumn("p", F.round("p", 9))


def level_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders in turn, by level of urgency."""
    level = F.get(F.array(F.lit(None), *map(F.lit, ["C", "B+", "B", "A"])), F.substring("o_orderpriority", 1, 1).cast("int"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    orders = table(spark, sf_dir, "orders").withColumn("level", level).withColumn("before", F.lag("level").over(w))
    return orders.groupBy("level", "before").agg(F.count_if(chars.level_at_least(F.col("level"), F.col("before"))).alias("n_at_least"), F.count("*").alias("n"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf_dir, "conversations").select("conv_id", F.lit(0).alias("sent_no"), (F.row_number().over(w) - 1).alias("phrase_no"), F.length("text").alias("n"))
    return t.withColumns({"opens": (F.col("n") % 3 == 0).cast("int"), "closes": (F.col("n") % 3 == 1).cast("int")})


def quote_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as phrases, their lengths as brackets: the pairs that no quotation forbids."""
    turns = _turns(spark, sf_dir)
    quotes = dependency.pair_quotes(turns, F.col("opens"), F.col("closes"), "conv_id")
    every = dependency.candidates(dependency.with_barrier(turns, F.lit(False), "conv_id"), F.lit("D"), "conv_id")
    return _long(dependency.mask_quotes(every, quotes, "conv_id").select("conv_id", "dependent", "governor"))


def bracket_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dependency.pair_quotes(_turns(spark, sf_dir), F.col("opens"), F.col("closes"), "conv_id")
    return _long(found.select("conv_id", "first", "last"))


def projective_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the tree of a conversation's turns, each hung on one that its length names, has crossing links."""
    turns = _turns(spark, sf_dir).withColumn("end", F.max("phrase_no").over(Window.partitionBy("conv_id")))
    heads = turns.where("phrase_no < end").select("conv_id", "sent_no", F.col("phrase_no").alias("dependent"), F.least(F.col("phrase_no") + 1 + F.col("n") % 3, F.col("end")).cast("int").alias("governor"))
    return dependency.is_projective(heads, "conv_id").select("conv_id", "projective")


def entity_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two or more capitalised words of a sentence as entities: labels by place, spans from the labels."""
    toks = sentences(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "sent_no", F.posexplode(tokens(F.col("sentence"))).alias("tok_no", "surface"))
    w = Window.partitionBy("doc_id", "sent_no").orderBy("tok_no")
    cap = F.col("surface").rlike(r"^\p{Lu}\p{L}+$")
    near = toks.withColumns({"cap": cap, "b": F.coalesce(F.lag(cap).over(w), F.lit(False)), "a": F.coalesce(F.lead(cap).over(w), F.lit(False))})
    place = F.when(~F.col("cap") | ~(F.col("a") | F.col("b")), "OTHER").when(~F.col("b"), "NAME:head").when(F.col("a"), "NAME:middle").otherwise("NAME:tail")
    found = entities.entity_spans(near.withColumn("label", place).select("doc_id", "sent_no", "tok_no", "surface", "label"), ["doc_id", "sent_no"], "tok_no")
    return _long(found)


def entity_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases that hold an entity's last word."""
    found = entity_runs(spark, sf_dir)
    phrases = structure.phrases(sentences(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", "sent_no", F.col("phrase_no").alias("unit_no"), F.col("first_tok").alias("first"), (F.col("first_tok") + F.col("n_tok") - 1).alias("last"))
    return entities.entities_to_units(found, phrases, ["doc_id", "sent_no"]).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("unit_no").alias("units"))


def table_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    return sinks.table_text(lines, ["l_orderkey"], "l_linenumber", ["l_linenumber", "l_partkey", "l_returnflag"])


def predicate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as the slots of its predicate; discounted ones are not overt, untaxed ones empty."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.lit(0).alias("predicate"), F.lit("order").alias("word"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("slot"),
        F.when(F.col("l_tax") > 0, F.col("l_partkey").cast("string")).alias("filler"), (F.col("l_discount") > 0.04).alias("overt"),
    )
    return sinks.predicate_arguments(lines, ["l_orderkey"]).select("l_orderkey", "text")


def query_term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks = table(spark, sf_dir, "conversations").select("conv_id", F.explode(tokens(F.lower("text"))).alias("t"))
    return entities.query_terms(toks, "conv_id", F.regexp_replace("t", r"[^\p{L}\p{N}]", "")).where("term <> ''")


def parentheses_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages cut into their text and their tags, and put together again."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("sent_id"), F.substring("url", 1, 200).alias("url"))
    parts = F.split("url", "/", -1)
    cut = pages.select("sent_id", F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise("")), "\u0001").alias("text"), F.slice(parts, 2, 99).alias("rest"))
    own = cut.select("sent_id", F.posexplode("rest").alias("i", "p")).select(F.concat("sent_id", F.lit("-"), F.lpad((F.col("i") + 1).cast("string"), 2, "0")).alias("sent_id"), F.concat(F.lit("/"), "p").alias("text"))
    return entities.merge_parentheses(cut.select("sent_id", "text"), own)


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of a turn as units: their number, word and kind."""
    toks = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(tokens(F.col("text"))).alias("place", "tok"))
    word = F.regexp_replace(F.lower("tok"), r"[^\p{L}\p{N}]", "")
    kind = F.when(F.col("tok").rlike(r"^\p{Lu}"), "NAME").when(F.col("tok").rlike("^[0-9]"), "NUMBER")
    return toks.select("conv_id", "turn", F.col("place").cast("long").alias("place"), "tok", word.alias("word"), kind.alias("kind"))


def appositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word with a comma and the next one, unless they are a name and a number."""
    return discourse.appositive_links(_names(spark, sf_dir), ["conv_id", "turn"], "place", F.col("tok").endswith(","))


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short words right after a name, as its titles."""
    short = (F.length("word") <= 2) & F.col("kind").isNull()
    return discourse.title_links(_names(spark, sf_dir), ["conv_id", "turn"], "place", short, F.coalesce(F.col("kind") == "NAME", F.lit(False)), "word")


def bridging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a conversation whose first three letters are an earlier word of it: the relation is made from its vocabulary."""
    words = _names(spark, sf_dir).where("word <> ''").select("conv_id", "turn", "word").distinct()
    known = words.select("word").distinct()
    relation = known.where("length(word) > 3").select(F.col("word").alias("part"), F.substring("word", 1, 3).alias("whole")).join(known.select(F.col("word").alias("whole")), "whole", "left_semi")
    return discourse.bridging_links(words, words, relation, "conv_id", "turn", 3)


def candidate_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which turns of a conversation may hang on which, as a matrix of lines."""
    turns = dependency.with_barrier(_turns(spark, sf_dir), F.col("closes") == 1, "conv_id")
    pairs = dependency.candidates(turns, F.when(F.col("g_n") > F.col("n"), "D").when(F.col("opens") == F.col("g_opens"), "P"), "conv_id")
    return sinks.matrix_lines(pairs, turns.groupBy("conv_id").agg(F.count("*").cast("int").alias("n")), ["conv_id"])


def feature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with the numbers of their features, brand and size."""
    own = F.array(F.concat(F.lit("b:"), "p_brand"), F.concat(F.lit("s:"), F.col("p_size").cast("string")), F.concat(F.lit("t:"), "p_type"))
    part = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") > 1000).cast("int").alias("y"), own.alias("fs"))
    names = part.select(F.explode("fs").alias("feature")).distinct().where("feature NOT LIKE 't:%'")
    numbers = names.withColumn("id", F.row_number().over(Window.orderBy("feature")))  # a dictionary of brands and sizes
    return sinks.vector_lines(part, ["p_partkey"], "y", "fs", numbers)


QUERIES = {
    f.__name__: f
    for f in (
        kana_width, affix_compare, word_classes, feature_drop, canonical_forms, predicate_keys, case_vectors, inflected_words, suffix_lookup, event_lift, class_prob, level_order, quote_masks,
        bracket_pairs, projective_trees, entity_runs, entity_units, table_lines, predicate_lines, query_term_counts, parentheses_merged,
        appositions, titles, bridging, candidate_matrix, feature_vectors,
    )
}

_QUOTED = HALF.replace("'", "''")
TURNS = """
    turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p, length(text) AS n FROM conversations),
    ends AS (SELECT conv_id, max(p) AS e FROM turns GROUP BY conv_id),
    marks AS (
        SELECT *, CASE n % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS d, sum(CASE n % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY p) AS s FROM turns
    ),
    lows AS (SELECT *, least(0, min(s) OVER (PARTITION BY conv_id ORDER BY p)) AS low FROM marks),
    quotes AS (
        SELECT o.conv_id, o.p AS first, coalesce(min(c.p), any_value(e.e)) AS last
        FROM lows o JOIN ends e USING (conv_id) LEFT JOIN lows c ON c.conv_id = o.conv_id AND c.p > o.p AND c.d = -1 AND c.s = o.s - 1
        WHERE o.d = 1 GROUP BY o.conv_id, o.p
        UNION ALL
        SELECT conv_id, 0, p FROM (SELECT *, coalesce(lag(low) OVER (PARTITION BY conv_id ORDER BY p), 0) AS was FROM lows) WHERE d = -1 AND low < was
    )
"""
RUNS = (
    TOKENS
    + r""",
    caps AS (SELECT *, regexp_matches(tok, '^\p{Lu}\p{L}+$') AS cap FROM tokens),
    islands AS (SELECT *, tok_no - row_number() OVER (PARTITION BY doc_id, sent_no ORDER BY tok_no) AS island FROM caps WHERE cap),
    runs AS (
        SELECT doc_id, sent_no, min(tok_no) AS first, max(tok_no) AS last, string_agg(tok, '' ORDER BY tok_no) AS text FROM islands GROUP BY doc_id, sent_no, island HAVING count(*) > 1
    )
"""
)

NAMES = r"""
    lists AS (SELECT conv_id, turn, regexp_extract_all(text, '[^ \t\r\n]+') AS ts FROM conversations),
    toks AS (SELECT conv_id, turn, unnest(ts) AS tok, generate_subscripts(ts, 1) - 1 AS place FROM lists),
    names AS (
        SELECT *, regexp_replace(lower(tok), '[^\p{L}\p{N}]', '', 'g') AS word, CASE WHEN regexp_matches(tok, '^\p{Lu}') THEN 'NAME' WHEN regexp_matches(tok, '^[0-9]') THEN 'NUMBER' END AS kind FROM toks
    )
"""

ORACLES = {
    "appositions": f"""
        WITH {NAMES}, near AS (SELECT *, lead(place) OVER w AS b, lead(kind) OVER w AS k FROM names WINDOW w AS (PARTITION BY conv_id, turn ORDER BY place))
        SELECT conv_id, turn, place AS a, b FROM near WHERE tok LIKE '%,' AND b IS NOT NULL AND (kind IS NULL OR k IS NULL OR kind = k)""",
    "titles": f"""
        WITH {NAMES}, near AS (SELECT *, lag(word) OVER w AS name, lag(kind) OVER w AS k FROM names WINDOW w AS (PARTITION BY conv_id, turn ORDER BY place))
        SELECT conv_id, turn, place, name FROM near WHERE length(word) <= 2 AND kind IS NULL AND k = 'NAME'""",
    "bridging": f"""
        WITH {NAMES}, words AS (SELECT DISTINCT conv_id, turn, word FROM names WHERE word <> ''), known AS (SELECT DISTINCT word FROM words),
        pairs AS (
            SELECT p.conv_id, p.turn, p.word AS part, w.word AS whole, w.turn AS whole_order, row_number() OVER (PARTITION BY p.conv_id, p.turn, p.word ORDER BY w.turn DESC, w.word) AS r
            FROM words p JOIN words w ON w.conv_id = p.conv_id AND w.turn < p.turn AND p.turn - w.turn <= 3 AND w.word = substr(p.word, 1, 3) WHERE length(p.word) > 3
        )
        SELECT conv_id, turn, part, whole, whole_order FROM pairs WHERE r = 1""",
    "candidate_matrix": f"""
        WITH {TURNS}, reach AS (
            SELECT m.*, coalesce((SELECT min(c.p) FROM marks c WHERE c.conv_id = m.conv_id AND c.p > m.p AND c.n % 3 = 1), e.e) AS reach FROM marks m JOIN ends e USING (conv_id)
        ),
        cells AS (
            SELECT a.conv_id, a.p AS i, b.p AS j, CASE WHEN b.p > a.p AND b.p <= a.reach THEN CASE WHEN b.n > a.n THEN 'D' WHEN (a.n % 3 = 0) = (b.n % 3 = 0) THEN 'P' ELSE '-' END ELSE '-' END AS t
            FROM reach a JOIN reach b ON a.conv_id = b.conv_id
        ),
        lines AS (SELECT conv_id, i, string_agg(t, '' ORDER BY j) AS l FROM cells GROUP BY conv_id, i)
        SELECT conv_id, string_agg(l, chr(10) ORDER BY i) AS text FROM lines GROUP BY conv_id""",
    "feature_vectors": """
        WITH f AS (SELECT p_partkey, p_retailprice > 1000 AS y, unnest(['b:' || p_brand, 's:' || p_size]) AS feature FROM part),
        ids AS (SELECT feature, row_number() OVER (ORDER BY feature) AS id FROM (SELECT DISTINCT feature FROM f))
        SELECT p_partkey, concat(y::INT, ' ', string_agg(concat(id, ':1'), ' ' ORDER BY id)) AS text FROM f JOIN ids USING (feature) GROUP BY p_partkey, y""",
    "kana_width": f"""
        WITH k AS (SELECT p_partkey, translate(CAST(p_partkey AS VARCHAR), '0123456789', '{KANA}') AS h, p_type FROM part)
        SELECT p_partkey, translate(h, '{HIRAGANA}', '{KATAKANA}') AS katakana, h AS hiragana, translate(p_type, '{_QUOTED}', '{FULL}') AS wide, p_type AS narrow FROM k""",
    "affix_compare": """
        WITH p AS (SELECT *, lag(p_type) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS b FROM part)
        SELECT p_partkey, CAST(list_max(list_filter(range(0, least(length(b), length(p_type)) + 1), lambda i: substr(b, 1, i) = substr(p_type, 1, i))) AS BIGINT) AS prefix,
            CAST(list_max(list_filter(range(0, least(length(b), length(p_type)) + 1), lambda i: right(b, i) = right(p_type, i))) AS BIGINT) AS suffix
        FROM p WHERE b IS NOT NULL""",
    "word_classes": rf"""
        WITH {TOKENS}
        SELECT CASE WHEN regexp_matches(tok, '^\p{{N}}+$') THEN 'digit' WHEN regexp_matches(tok, '^\p{{Latin}}+$') THEN 'letter' WHEN regexp_matches(tok, '^[\p{{P}}\p{{S}}]+$') THEN 'symbol' ELSE 'mixed' END AS class,
            regexp_matches(tok, '[\p{{P}}\p{{S}}]$') AS ends_in_symbol, length(tok) = 1 AS single, count(*) AS n
        FROM tokens GROUP BY ALL""",
    "feature_drop": "SELECT p_partkey, concat('size:', p_size, ':cm,brandy') AS kept, concat('size:', p_size) AS field, false AS has_brand FROM part",
    "canonical_forms": """
        SELECT p_partkey, array_to_string(list_transform(list_filter(string_split(p_type, ' '), lambda w: length(w) > 3), lambda w: w || '/' || lower(w)), '+') AS form FROM part""",
    "predicate_keys": """
        WITH o AS (
            SELECT lower(o_orderstatus) AS s, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 1 WHEN '2' THEN 3 WHEN '3' THEN 12 ELSE 0 END AS v, o_orderstatus = 'O' AS copula, o_totalprice > 200000 AS neg FROM orders
        )
        SELECT s || CASE WHEN copula THEN '+copula' ELSE '' END || CASE WHEN neg THEN '+not' ELSE '' END || ':verb' || CASE WHEN v > 0 THEN ':' || v ELSE '' END AS key, CAST(v AS BIGINT) AS voices, count(*) AS n
        FROM o GROUP BY ALL""",
    "case_vectors": """
        WITH l AS (
            SELECT l_partkey, bool_or(l_returnflag = 'A') AS a, bool_or(l_returnflag = 'N') AS n, bool_or(l_returnflag = 'R') AS r,
                coalesce(bool_or(l_returnflag = 'A') FILTER (l_suppkey % 2 = 0), false) AS a2, coalesce(bool_or(l_returnflag = 'N') FILTER (l_suppkey % 2 = 0), false) AS n2, coalesce(bool_or(l_returnflag = 'R') FILTER (l_suppkey % 2 = 0), false) AS r2
            FROM lineitem GROUP BY l_partkey
        )
        SELECT l_partkey, concat(a::INT, n::INT, r::INT, '00000000') AS either, concat(a2::INT, n2::INT, r2::INT, '00000000') AS both, CASE WHEN a THEN 'ga' WHEN n THEN 'wo' ELSE 'ni' END AS first_case FROM l""",
    "inflected_words": """
        WITH w AS (SELECT DISTINCT unnest(string_split(p_type, ' ')) AS word FROM part)
        SELECT word, CASE WHEN word LIKE '%ED' THEN left(word, length(word) - 2) || 'ING' WHEN word LIKE '%L' THEN NULL WHEN word LIKE '%ING' THEN left(word, length(word) - 3) || 'ED' END AS inflected FROM w""",
    "suffix_lookup": """
        WITH ws AS (SELECT p_partkey, p_brand, string_split(p_type, ' ') AS ws FROM part),
        known AS (
            SELECT key, max(value) AS value FROM (SELECT ws[-1] AS key, 'word' AS value FROM ws UNION ALL SELECT array_to_string(ws, ''), 'type' FROM ws WHERE p_brand = 'Brand#13') GROUP BY key
        ),
        each_ AS (SELECT p_partkey, ws, unnest(range(1, len(ws) + 1)) AS i FROM ws),
        found AS (SELECT p_partkey, arg_min(value, i) AS found FROM each_ JOIN known ON key = array_to_string(ws[i:], '') GROUP BY p_partkey)
        SELECT p_partkey, found FROM ws LEFT JOIN found USING (p_partkey)""",
    "event_lift": """
        WITH p AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events),
        n AS (SELECT a, b, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY ALL),
        l AS (SELECT a, b, (n / sum(n) OVER ()) / ((sum(n) OVER (PARTITION BY a) / sum(n) OVER ()) * (sum(n) OVER (PARTITION BY b) / sum(n) OVER ())) AS x FROM n)
        SELECT a, b, round(x, 6) AS lift, round(1 / (1 + exp(-10 * (x - 1))), 6) AS p, CAST(least(floor(least(x / 2, 1) * 10), 9) AS BIGINT) AS bin FROM l""",
    "class_prob": """
        WITH e AS (SELECT p_partkey, p_brand, unnest(string_split(p_type, ' ')) AS c FROM part),
        n AS (SELECT *, count(*) OVER (PARTITION BY c) AS nc, count(*) OVER (PARTITION BY p_brand, c) AS nbc, count(*) OVER (PARTITION BY p_brand) AS nb, count(*) OVER () AS t FROM e)
        SELECT p_partkey, p_brand, round(sum((nbc / nb) / (nc / t) * (1 / nc)), 9) AS p FROM n GROUP BY ALL""",
    "level_order": """
        WITH o AS (SELECT *, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'C' WHEN '2' THEN 'B+' WHEN '3' THEN 'B' WHEN '4' THEN 'A' END AS level FROM orders),
        b AS (SELECT level, lag(level) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM o)
        SELECT level, before, count(*) FILTER (CASE WHEN level IS NULL THEN true WHEN before IS NULL THEN false ELSE list_position(['A', 'B', 'B+', 'C'], level) >= list_position(['A', 'B', 'B+', 'C'], before) END) AS n_at_least, count(*) AS n
        FROM b GROUP BY ALL""",
    "quote_masks": f"""
        WITH {TURNS}
        SELECT a.conv_id, a.p AS dependent, b.p AS governor FROM turns a JOIN turns b ON a.conv_id = b.conv_id AND b.p > a.p
        WHERE NOT EXISTS (
            SELECT 1 FROM quotes q WHERE q.conv_id = a.conv_id AND q.first < q.last
                AND ((a.p < q.first AND b.p >= q.first AND b.p < q.last) OR (a.p >= q.first AND a.p < q.last AND b.p > q.last)))""",
    "bracket_pairs": f"""WITH {TURNS} SELECT conv_id, CAST(first AS BIGINT) AS "first", CAST(last AS BIGINT) AS "last" FROM quotes""",
    "projective_trees": """
        WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p, length(text) AS n, count(*) OVER (PARTITION BY conv_id) - 1 AS e FROM conversations),
        h AS (SELECT conv_id, p AS d, least(p + 1 + n % 3, e) AS g FROM t WHERE p < e)
        SELECT a.conv_id, NOT bool_or(coalesce(b.d > a.d AND b.d < a.g AND b.g > a.g, false)) AS projective FROM h a LEFT JOIN h b ON b.conv_id = a.conv_id GROUP BY a.conv_id""",
    "entity_runs": f"""WITH {RUNS} SELECT doc_id, CAST(sent_no AS BIGINT) AS sent_no, CAST(first AS BIGINT) AS "first", CAST(last AS BIGINT) AS "last", 'NAME' AS kind, text FROM runs""",
    "entity_units": f"""
        WITH {RUNS}, nos AS (
            SELECT doc_id, sent_no, tok_no, sum(CASE WHEN tok_no = 0 OR NOT fn THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, sent_no ORDER BY tok_no) - 1 AS unit_no FROM marked
        )
        SELECT r.doc_id, count(*) AS n, CAST(sum(unit_no) AS BIGINT) AS units FROM runs r JOIN nos n ON n.doc_id = r.doc_id AND n.sent_no = r.sent_no AND n.tok_no = r.last GROUP BY r.doc_id""",
    "table_lines": """
        SELECT l_orderkey, concat('l_linenumber', chr(9), 'l_partkey', chr(9), 'l_returnflag', chr(10),
            string_agg(concat(l_linenumber, chr(9), l_partkey, chr(9), l_returnflag), chr(10) ORDER BY l_linenumber, concat(l_linenumber, chr(9), l_partkey, chr(9), l_returnflag))) AS text
        FROM lineitem GROUP BY l_orderkey""",
    "predicate_lines": """
        WITH s AS (
            SELECT l_orderkey, concat(l_returnflag, l_linenumber, ':', CASE WHEN NOT l_tax > 0 THEN '-' WHEN l_discount > 0.04 THEN CAST(l_partkey AS VARCHAR) ELSE concat('[', l_partkey, ']') END) AS x FROM lineitem
        )
        SELECT l_orderkey, 'order ' || string_agg(x, ' ' ORDER BY x) AS text FROM s GROUP BY l_orderkey""",
    "query_term_counts": r"""
        WITH t AS (SELECT conv_id, regexp_replace(unnest(regexp_extract_all(lower(text), '[^ \t\r\n]+')), '[^\p{L}\p{N}]', '', 'g') AS term FROM conversations)
        SELECT conv_id, term, count(*) AS n FROM t WHERE term <> '' GROUP BY ALL""",
    "parentheses_merged": "SELECT CAST(page_id AS VARCHAR) AS sent_id, substr(url, 1, 200) AS text FROM pages",
}
