"""Catalogue queries over documents, conversations and pages, each with the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.functions import chars
from glossa.functions.similarity import set_pairs
from glossa.operators import dependency, structure
from glossa.operators.structure import is_function, sentences, tokens
from glossa.plans.session import table

SENTENCES = r"""
    sentence_lists AS (
        SELECT doc_id, lang, source, list_filter(list_transform(regexp_extract_all(text, '[^.!?\n]+[.!?]*'), lambda s: trim(s)), lambda s: s <> '') AS ss
        FROM documents
    ),
    sentences AS (SELECT doc_id, lang, source, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS sent_no FROM sentence_lists)
"""
TOKENS = (
    SENTENCES
    + r""",
    token_lists AS (SELECT doc_id, lang, source, sent_no, regexp_extract_all(sentence, '[^ \t\r\n]+') AS ts FROM sentences),
    tokens AS (
        SELECT doc_id, lang, source, sent_no, unnest(ts) AS tok, generate_subscripts(ts, 1) - 1 AS tok_no FROM token_lists
    ),
    marked AS (SELECT *, regexp_matches(tok, '^\p{Ll}{1,3}[,.!?]*$') AS fn FROM tokens)
"""
)
PHRASES = (
    TOKENS
    + r""",
    numbered AS (
        SELECT *, sum(CASE WHEN tok_no = 0 OR NOT fn THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, sent_no ORDER BY tok_no) - 1 AS phrase_no
        FROM marked
    ),
    phrases AS (
        SELECT doc_id, sent_no, CAST(phrase_no AS BIGINT) AS phrase_no, min(tok_no) AS first_tok, count(*) AS n_tok,
            coalesce(arg_max(tok, tok_no) FILTER (NOT fn), arg_min(tok, tok_no)) AS head, arg_max(tok, tok_no) AS last
        FROM numbered GROUP BY doc_id, sent_no, phrase_no
    )
"""
)
REACH = (
    PHRASES
    + r""",
    reaching AS (
        SELECT *, coalesce(
            min(CASE WHEN last LIKE '%,' THEN phrase_no END) OVER (PARTITION BY doc_id, sent_no ORDER BY phrase_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),
            max(phrase_no) OVER (PARTITION BY doc_id, sent_no)) AS reach
        FROM phrases
    ),
    pairs AS (
        SELECT d.doc_id, d.sent_no, d.phrase_no AS dependent, g.phrase_no AS governor,
            CASE WHEN g.n_tok > 1 THEN 'D' WHEN d.n_tok = g.n_tok THEN 'P' END AS type
        FROM reaching d JOIN reaching g ON d.doc_id = g.doc_id AND d.sent_no = g.sent_no AND g.phrase_no > d.phrase_no AND g.phrase_no <= d.reach
    ),
    candidates AS (SELECT * FROM pairs WHERE type IS NOT NULL)
"""
)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.phrases(sentences(_documents(spark, sf_dir)))


def _reaching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.phrases(sentences(_documents(spark, sf_dir)), barrier=lambda last: last.endswith(","))


def _reaching_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.phrase_arrays(sentences(_documents(spark, sf_dir)), barrier=lambda last: last.endswith(","))


def _kind(p: Column, g: Column) -> Column:
    """Phrases of several tokens govern all, others their equals."""
    return F.when(g["n_tok"] > 1, "D").when(p["n_tok"] == g["n_tok"], "P")


#: _kind by rules; a phrase has one token at least.
_RULES = (("D", lambda g: g["n_tok"] > 1, lambda p: F.lit(True)), ("P", lambda g: g["n_tok"] == 1, lambda p: p["n_tok"] == 1))


def _long(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c, t in df.dtypes if t == "int"})


def char_class_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [F.sum(chars.count_of(F.col("text"), kind)).cast("long").alias(kind) for kind in chars.KINDS]
    return _documents(spark, sf_dir).groupBy("lang", "source").agg(*counts, F.sum(F.length("text")).alias("all_chars"))


def unknown_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.operators.lattice import run_kind, unknown_runs

    runs = _documents(spark, sf_dir).select("lang", F.explode(unknown_runs(F.col("text"))).alias("run")).select("lang", run_kind(F.col("run")).alias("kind"), F.length("run").cast("long").alias("n_chars"))
    return runs.groupBy("lang", "kind", "n_chars").agg(F.count("*").alias("n"))


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(sentences(_documents(spark, sf_dir)))


def repetition_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.operators.lattice import is_repetition

    tok = sentences(_documents(spark, sf_dir)).select(F.explode(tokens(F.lower("sentence"))).alias("tok"))
    bare = tok.select(F.regexp_replace("tok", r"[^\p{L}]", "").alias("tok"))
    return bare.where(is_repetition(F.col("tok"))).groupBy("tok").agg(F.count("*").alias("n"))


def numeral_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks = _documents(spark, sf_dir).select("doc_id", F.posexplode(tokens(F.col("text"))).alias("tok_no", "tok"))
    number = F.when(F.col("tok").rlike(r"^[0-9][0-9.,]*$"), "n")
    merged = structure.merge_runs(toks, ["doc_id"], ["tok_no"], number)
    return merged.where(number.isNotNull()).groupBy("doc_id", "run").agg(F.count("*").alias("n_merged"), F.min("tok_no").cast("long").alias("first_tok")).drop("run")


def bracket_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    depth = structure.bracket_depths(F.col("html"), "<", ">")
    found = table(spark, sf_dir, "pages").select("page_id", depth.alias("d"))
    return _long(found.select("page_id", "d.deepest", "d.ends", "d.lowest"))


def paren_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = structure.split_brackets(table(spark, sf_dir, "pages"), "page_id", "html", "<", ">")
    per = parts.groupBy("page_id").agg(
        F.max(F.when(F.col("part_no") == 0, F.length("part"))).alias("main_chars"), (F.count("*") - 1).alias("n_parts"), F.sum(F.when(F.col("part_no") > 0, F.length("part")).otherwise(0)).alias("part_chars")
    )
    return _long(per)


def homograph_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spellings of a word as alternatives, most frequent first: its base form is preferred where it is one of them."""
    from glossa.operators.rules import choose_homographs, parse_pattern

    toks = sentences(_documents(spark, sf_dir)).select(F.explode(tokens(F.col("sentence"))).alias("surface"))
    counts = toks.groupBy("surface").agg(F.count("*").alias("n")).withColumn("lemma", F.lower("surface"))
    pos = F.when(F.col("surface") == F.col("lemma"), "base").otherwise("variant")
    row = F.struct((-F.col("n")).alias("order"), "surface", "lemma", pos.alias("pos"))
    groups = counts.groupBy("lemma").agg(F.array_sort(F.collect_list(row)).alias("alternatives"))  # as many as a word has spellings
    found = choose_homographs(groups, [parse_pattern("[pos=base] [pos=variant]")], ["lemma"])
    best = F.get("alternatives", F.col("chosen"))
    return found.select("lemma", best["surface"].alias("surface"), (-best["order"]).alias("n"), F.size("alternatives").cast("long").alias("variants"))


def chunk_running_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_phrases(spark, sf_dir).select("doc_id", "sent_no", "phrase_no", "first_tok", "n_tok"))


def head_of_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phrases(spark, sf_dir).groupBy("head").agg(F.count("*").alias("n"), F.sum("n_tok").alias("n_tok"))


def dpnd_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _reaching_arrays(spark, sf_dir).select("doc_id", F.inline_outer(dependency.count_ruled("ps", _RULES)))
    return counts.groupBy("doc_id", "type").agg(F.sum("n").alias("n"), F.sum("distance").alias("distance")).where("n > 0")


def barrier_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_reaching(spark, sf_dir).groupBy("doc_id", "sent_no").agg(F.sum(F.col("reach") - F.col("phrase_no")).alias("allowed"), F.count("*").alias("n")))


def relax_last_possible(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dependency.relaxed_governors("ps", _kind, lambda g: g["last"].rlike(r"[)\]}»\"]$"))
    return _long(dependency.links(_reaching_arrays(spark, sf_dir), found, ["doc_id", "sent_no"]))


def default_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = _reaching_arrays(spark, sf_dir).select("doc_id", dependency.default_governors("ps", _kind, 2).alias("gs"))
    zero = F.lit(0).cast("long")
    n, distance = F.size(F.filter("gs", lambda g: g.isNotNull())), F.aggregate(F.transform("gs", lambda g, i: F.coalesce(g - i, F.lit(0))), zero, lambda a, d: a + d)
    return heads.select("doc_id", n.cast("long").alias("n"), distance.alias("distance")).groupBy("doc_id").agg(F.sum("n").alias("n"), F.sum("distance").alias("distance")).where("n > 0")


def correlative_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks = sentences(_documents(spark, sf_dir)).select("doc_id", "sent_no", F.posexplode(tokens(F.lower("sentence"))).alias("tok_no", "tok"))
    found = dependency.correlatives(toks, F.col("tok").isin("from", "de", "von"), F.col("tok").isin("to", "a", "la", "zu"), "tok_no", ["doc_id", "sent_no"])
    return _long(found)


def set_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by the words they use."""
    words = sentences(_documents(spark, sf_dir).withColumn("source", F.coalesce("source", F.lit("?"))), "source").select("source", F.explode(tokens(F.lower("sentence"))).alias("w"))
    return set_pairs(words, "source", "w").withColumn("similarity", F.round("similarity", 6))


def noun_verb_mi_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = sentences(_documents(spark, sf_dir)).select(tokens(F.lower("sentence")).alias("ts"))
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("ts") - 1, F.lit(1))), lambda i: F.struct(F.get("ts", i - 1).alias("w1"), F.get("ts", i).alias("w2"))))
    counts = ts.where(F.size("ts") > 1).select(pair.alias("p")).groupBy("p.w1", "p.w2").agg(F.count("*").alias("n")).where("n >= 5")
    total = counts.agg(F.sum("n").alias("total"))
    sums = counts.withColumn("n2", F.sum("n").over(Window.partitionBy("w2"))).withColumn("n1", F.sum("n").over(Window.partitionBy("w1")))
    mi = F.round(F.log(F.col("n") * F.col("total") / F.col("n1") / F.col("n2")), 6)
    scored = sums.join(F.broadcast(total)).withColumn("mi", mi)  # one row
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("w1").orderBy(F.desc("mi"), "w2")).cast("long")).where("rank <= 3").select("w1", "w2", "n", "mi", "rank")


def ne_window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks = sentences(_documents(spark, sf_dir)).select("doc_id", "sent_no", F.posexplode(tokens(F.col("sentence"))).alias("tok_no", "tok"))
    shape = F.when(F.col("tok").rlike(r"^\p{Lu}"), "cap").when(F.col("tok").rlike(r"^[0-9]"), "num").when(is_function(F.col("tok")), "fn").otherwise("low")
    w = Window.partitionBy("doc_id", "sent_no").orderBy("tok_no")
    named = toks.withColumn("shape", shape)
    at = {name: F.coalesce(F.lag("shape", k).over(w) if k > 0 else F.lead("shape", -k).over(w), F.lit("-")) for name, k in (("l2", 2), ("l1", 1), ("r1", -1), ("r2", -2))}
    return named.withColumns(at).groupBy("l2", "l1", "shape", "r1", "r2").agg(F.count("*").alias("n"))


SYNONYMS = [("ing", "ed"), ("ung", "en"), ("tion", "ment"), ("s", "d"), ("la", "re")]


def synonym_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of words that differ in a pair of endings, wherever these stand."""
    from glossa.operators.discourse import synonym_pairs

    words = sentences(_documents(spark, sf_dir)).select(F.explode(tokens(F.lower("sentence"))).alias("w")).select(F.regexp_replace("w", r"[^\p{L}]", "").alias("word")).where(F.length("word") > 4)
    return synonym_pairs(words, spark.createDataFrame(SYNONYMS, "x string, y string"))


def tree_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees in which a phrase hangs on its barrier and a barrier on the next one: depth counts the links to the root.

    The path is as long as there are barriers ahead, so a window replaces the recursion.
    """
    ahead = dependency.sentence_window("doc_id").rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy("doc_id", "sent_no")
    barrier = F.col("last").endswith(",")
    end = F.max("phrase_no").over(whole)
    p = _phrases(spark, sf_dir).withColumn("end", end).withColumn("stop", barrier & (F.col("phrase_no") < F.col("end")))
    depth = p.withColumn("depth", F.count_if("stop").over(ahead) + F.when(F.col("phrase_no") < F.col("end"), 1).otherwise(0))
    return _long(depth.groupBy("doc_id", "sent_no").agg(F.max("depth").alias("deepest"), F.sum("depth").alias("total")))


def ne_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a turn, and how many of them were names in an earlier turn of the conversation."""
    from glossa.operators.entities import cached_label

    toks = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(tokens(F.col("text"))).alias("tok"))
    label = F.when(F.max(F.col("tok").rlike(r"^\p{Lu}")), "NAME").otherwise("OTHER")
    terms = toks.groupBy("conv_id", "turn", F.lower("tok").alias("term")).agg(label.alias("label"))
    seen = cached_label(terms, "conv_id", "turn", "term", "label")
    return seen.groupBy("conv_id", "turn").agg(F.count("*").alias("n_words"), F.count("cached").alias("n_cached"))


def coref_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.operators.discourse import mentions, nearest_antecedent

    found = nearest_antecedent(mentions(table(spark, sf_dir, "conversations"), "conv_id", "turn"), "conv_id", "turn", 20)
    return found.groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.sum("distance").alias("distance"))


def salience_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.operators.discourse import mentions, salience

    m = mentions(table(spark, sf_dir, "conversations"), "conv_id", "turn").withColumn("weight", F.when(F.col("at") == 0, 2.0).otherwise(1.0))
    scored = salience(m, "conv_id", "turn", "entity", "weight")
    return scored.select("conv_id", "turn", "entity", F.round("salience", 6).alias("salience"))


def modality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.count_if(t.contains("?")).alias("questions"), F.count_if(t.contains("!")).alias("exclamations"),
        F.count_if(t.rlike(r"(?i)\b(?:can|must|should|please|bitte|por favor)\b")).alias("requests"), F.count_if(F.col("role") == "user").alias("by_user"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        char_class_profile, unknown_word_runs, sentence_split, repetition_tokens, numeral_merge, bracket_depth, paren_split, homograph_choice, chunk_running_sum,
        head_of_chunk, dpnd_candidates, barrier_prune, relax_last_possible, default_position, correlative_pairs, set_similarity, noun_verb_mi_rank, ne_window_features,
        synonym_strip, tree_depth, ne_cache, coref_nearest, salience_decay, modality_counts,
    )
}

MENTIONS = r"""
    mentions AS (
        SELECT conv_id, turn, entity, min(place) - 1 AS place FROM (
            SELECT conv_id, turn, lower(unnest(ws)) AS entity, generate_subscripts(ws, 1) AS place
            FROM (SELECT conv_id, turn, regexp_extract_all(text, '\p{Lu}\p{L}+') AS ws FROM conversations)
        ) GROUP BY conv_id, turn, entity
    )
"""

ORACLES = {
    "char_class_profile": r"""
        SELECT lang, source, CAST(sum(length(regexp_replace(text, '[^\p{Lu}]', '', 'g'))) AS BIGINT) AS upper, CAST(sum(length(regexp_replace(text, '[^\p{Ll}]', '', 'g'))) AS BIGINT) AS lower,
            CAST(sum(length(regexp_replace(text, '[^\p{N}]', '', 'g'))) AS BIGINT) AS digit, CAST(sum(length(regexp_replace(text, '[^\p{P}\p{S}]', '', 'g'))) AS BIGINT) AS symbol,
            CAST(sum(length(text)) AS BIGINT) AS all_chars
        FROM documents GROUP BY lang, source""",
    "unknown_word_runs": r"""
        WITH runs AS (SELECT lang, unnest(regexp_extract_all(text, '[\x{30A0}-\x{30FF}]+|\p{Nd}+|\p{L}[.\p{L}]*|(?s:.)')) AS run FROM documents)
        SELECT lang, CASE WHEN regexp_matches(run, '^ ') THEN 'space' WHEN regexp_matches(run, '^\p{Nd}') THEN 'digit' WHEN regexp_matches(run, '^\p{L}') THEN 'letter' ELSE 'symbol' END AS kind,
            CAST(length(run) AS BIGINT) AS n_chars, count(*) AS n
        FROM runs GROUP BY ALL""",
    "sentence_split": f"WITH {SENTENCES} SELECT doc_id, CAST(sent_no AS BIGINT) AS sent_no, sentence FROM sentences",
    "repetition_tokens": rf"""
        WITH {SENTENCES},
        bare AS (SELECT regexp_replace(unnest(regexp_extract_all(lower(sentence), '[^ \t\r\n]+')), '[^\p{{L}}]', '', 'g') AS tok FROM sentences)
        SELECT tok, count(*) AS n FROM bare
        WHERE length(tok) IN (4, 6, 8) AND substr(tok, 1, length(tok) // 2) = substr(tok, length(tok) // 2 + 1) AND tok <> repeat(substr(tok, 1, 1), length(tok)) GROUP BY tok""",
    "numeral_merge": r"""
        WITH lists AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\r\n]+') AS ts FROM documents),
        toks AS (SELECT doc_id, unnest(ts) AS tok, generate_subscripts(ts, 1) - 1 AS tok_no FROM lists),
        numbers AS (
            SELECT doc_id, tok_no, tok_no - row_number() OVER (PARTITION BY doc_id ORDER BY tok_no) AS island FROM toks WHERE regexp_matches(tok, '^[0-9][0-9.,]*$')
        )
        SELECT doc_id, count(*) AS n_merged, CAST(min(tok_no) AS BIGINT) AS first_tok FROM numbers GROUP BY doc_id, island""",
    "bracket_depth": r"""
        WITH lists AS (SELECT page_id, regexp_extract_all(html, '[<>]') AS ms FROM pages),
        marks AS (SELECT page_id, unnest(ms) AS m, generate_subscripts(ms, 1) AS i FROM lists),
        sums AS (SELECT page_id, i, sum(CASE m WHEN '<' THEN 1 ELSE -1 END) OVER (PARTITION BY page_id ORDER BY i) AS d FROM marks)
        SELECT page_id, CAST(greatest(max(d), 0) AS BIGINT) AS deepest, CAST(arg_max(d, i) AS BIGINT) AS ends, CAST(least(min(d), 0) AS BIGINT) AS lowest
        FROM sums GROUP BY page_id""",
    "paren_split": r"""
        WITH lists AS (SELECT page_id, string_split(html, '') AS cs FROM pages),
        chars AS (SELECT page_id, unnest(cs) AS c, generate_subscripts(cs, 1) AS i FROM lists),
        sums AS (SELECT *, sum(CASE c WHEN '<' THEN 1 WHEN '>' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS s FROM chars),
        lows AS (SELECT *, least(0, min(s) OVER (PARTITION BY page_id ORDER BY i)) AS low FROM sums),
        depths AS (SELECT *, s - low AS depth, low < coalesce(lag(low) OVER (PARTITION BY page_id ORDER BY i), 0) AS loose FROM lows),
        told AS (
            SELECT *, coalesce(lag(depth) OVER (PARTITION BY page_id ORDER BY i), 0) AS before FROM depths
        ),
        kinds AS (
            SELECT *, c = '<' AND before = 0 AS opens, c = '>' AND depth = 0 AND NOT loose AS closes FROM told
        )
        SELECT page_id, count(*) FILTER (loose OR (before = 0 AND NOT opens)) AS main_chars,
            count(*) FILTER (opens) AS n_parts, count(*) FILTER (before > 0 AND NOT closes) AS part_chars
        FROM kinds GROUP BY page_id""",
    "homograph_choice": f"""
        WITH {TOKENS}, counts AS (SELECT tok AS surface, lower(tok) AS lemma, count(*) AS n FROM tokens GROUP BY tok),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lemma ORDER BY CASE WHEN surface = lemma THEN 0 ELSE 1 END, n DESC, surface) AS r, count(*) OVER (PARTITION BY lemma) AS variants
            FROM counts
        )
        SELECT lemma, surface, n, variants FROM ranked WHERE r = 1""",
    "chunk_running_sum": f"WITH {PHRASES} SELECT doc_id, CAST(sent_no AS BIGINT) AS sent_no, phrase_no, CAST(first_tok AS BIGINT) AS first_tok, n_tok FROM phrases",
    "head_of_chunk": f"WITH {PHRASES} SELECT head, count(*) AS n, CAST(sum(n_tok) AS BIGINT) AS n_tok FROM phrases GROUP BY head",
    "dpnd_candidates": f"WITH {REACH} SELECT doc_id, type, count(*) AS n, CAST(sum(governor - dependent) AS BIGINT) AS distance FROM candidates GROUP BY ALL",
    "barrier_prune": f"""
        WITH {REACH} SELECT doc_id, CAST(sent_no AS BIGINT) AS sent_no, CAST(sum(reach - phrase_no) AS BIGINT) AS allowed, count(*) AS n FROM reaching GROUP BY doc_id, sent_no""",
    "relax_last_possible": rf"""
        WITH {REACH}, ends AS (SELECT doc_id, sent_no, max(phrase_no) AS e FROM phrases GROUP BY ALL)
        SELECT p.doc_id, CAST(p.sent_no AS BIGINT) AS sent_no, p.phrase_no AS dependent, p.reach AS governor
        FROM reaching p JOIN ends e USING (doc_id, sent_no) JOIN phrases g ON g.doc_id = p.doc_id AND g.sent_no = p.sent_no AND g.phrase_no = p.reach
        WHERE p.phrase_no < p.reach AND (p.reach = e.e OR regexp_matches(g.last, '[)\]}}»"]$'))
            AND NOT EXISTS (SELECT 1 FROM candidates c WHERE c.doc_id = p.doc_id AND c.sent_no = p.sent_no AND c.dependent = p.phrase_no)""",
    "default_position": f"""
        WITH {REACH}, ranked AS (
            SELECT *, row_number() OVER (PARTITION BY doc_id, sent_no, dependent ORDER BY governor) AS r, count(*) OVER (PARTITION BY doc_id, sent_no, dependent) AS n FROM candidates
        )
        SELECT doc_id, count(*) AS n, CAST(sum(governor - dependent) AS BIGINT) AS distance FROM ranked WHERE r = least(2, n) GROUP BY doc_id""",
    "correlative_pairs": f"""
        WITH {TOKENS}, found AS (
            SELECT doc_id, sent_no, tok_no, lower(tok) AS tok,
                min(CASE WHEN lower(tok) IN ('to', 'a', 'la', 'zu') THEN tok_no END) OVER (PARTITION BY doc_id, sent_no ORDER BY tok_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS e
            FROM tokens
        )
        SELECT doc_id, CAST(sent_no AS BIGINT) AS sent_no, CAST(tok_no AS BIGINT) AS "start", CAST(e AS BIGINT) AS "end" FROM found WHERE tok IN ('from', 'de', 'von') AND e IS NOT NULL""",
    "set_similarity": rf"""
        WITH {SENTENCES}, words AS (SELECT DISTINCT coalesce(source, '?') AS source, unnest(regexp_extract_all(lower(sentence), '[^ \t\r\n]+')) AS w FROM sentences),
        size AS (SELECT source, count(*) AS n FROM words GROUP BY source),
        both_ AS (SELECT a.source AS s1, b.source AS s2, count(*) AS common FROM words a JOIN words b ON a.w = b.w AND a.source < b.source GROUP BY ALL)
        SELECT s1, s2, common, round((common / (x.n + y.n - common) + common / least(x.n, y.n)) / 2, 6) AS similarity
        FROM both_ JOIN size x ON x.source = s1 JOIN size y ON y.source = s2 WHERE common >= 3""",
    "noun_verb_mi_rank": rf"""
        WITH {SENTENCES}, lists AS (SELECT regexp_extract_all(lower(sentence), '[^ \t\r\n]+') AS ts FROM sentences),
        pairs AS (SELECT unnest(ts[:-2]) AS w1, unnest(ts[2:]) AS w2 FROM lists WHERE len(ts) > 1),
        counts AS (SELECT w1, w2, count(*) AS n FROM pairs GROUP BY ALL HAVING count(*) >= 5),
        scored AS (
            SELECT w1, w2, n, round(ln(n * (SELECT sum(n) FROM counts) / sum(n) OVER (PARTITION BY w1) / sum(n) OVER (PARTITION BY w2)), 6) AS mi FROM counts
        ),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY w1 ORDER BY mi DESC, w2) AS rank FROM scored)
        SELECT w1, w2, n, mi, rank FROM ranked WHERE rank <= 3""",
    "ne_window_features": rf"""
        WITH {TOKENS}, shaped AS (
            SELECT *, CASE WHEN regexp_matches(tok, '^\p{{Lu}}') THEN 'cap' WHEN regexp_matches(tok, '^[0-9]') THEN 'num' WHEN fn THEN 'fn' ELSE 'low' END AS shape FROM marked
        ),
        around AS (
            SELECT coalesce(lag(shape, 2) OVER w, '-') AS l2, coalesce(lag(shape) OVER w, '-') AS l1, shape, coalesce(lead(shape) OVER w, '-') AS r1, coalesce(lead(shape, 2) OVER w, '-') AS r2
            FROM shaped WINDOW w AS (PARTITION BY doc_id, sent_no ORDER BY tok_no)
        )
        SELECT l2, l1, shape, r1, r2, count(*) AS n FROM around GROUP BY ALL""",
    "synonym_strip": rf"""
        WITH {SENTENCES}, words AS (
            SELECT DISTINCT w FROM (SELECT regexp_replace(unnest(regexp_extract_all(lower(sentence), '[^ \t\r\n]+')), '[^\p{{L}}]', '', 'g') AS w FROM sentences) WHERE length(w) > 4
        ),
        syn AS (SELECT unnest(['ing', 'ung', 'tion', 's', 'la']) AS x, unnest(['ed', 'en', 'ment', 'd', 're']) AS y),
        places AS (SELECT w, x, y, unnest(range(1, length(w) - length(x) + 2)) AS i FROM words, syn WHERE length(w) >= length(x)),
        made AS (SELECT w AS a, substr(w, 1, i - 1) || y || substr(w, i + length(x)) AS b FROM places WHERE substr(w, i, length(x)) = x)
        SELECT DISTINCT a, b FROM made JOIN words ON words.w = made.b""",
    "tree_depth": f"""
        WITH RECURSIVE {REACH}, ends AS (SELECT doc_id, sent_no, max(phrase_no) AS e FROM phrases GROUP BY ALL),
        links AS (SELECT p.doc_id, p.sent_no, p.phrase_no, p.reach AS head, e.e FROM reaching p JOIN ends e USING (doc_id, sent_no)),
        walk AS (
            SELECT doc_id, sent_no, phrase_no, phrase_no AS at, 0 AS depth FROM links
            UNION ALL
            SELECT w.doc_id, w.sent_no, w.phrase_no, l.head, w.depth + 1
            FROM walk w JOIN links l ON l.doc_id = w.doc_id AND l.sent_no = w.sent_no AND l.phrase_no = w.at WHERE w.at < l.e
        ),
        depths AS (SELECT doc_id, sent_no, phrase_no, max(depth) AS depth FROM walk GROUP BY ALL)
        SELECT doc_id, CAST(sent_no AS BIGINT) AS sent_no, CAST(max(depth) AS BIGINT) AS deepest, CAST(sum(depth) AS BIGINT) AS total FROM depths GROUP BY doc_id, sent_no""",
    "ne_cache": r"""
        WITH toks AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[^ \t\r\n]+')) AS tok FROM conversations),
        terms AS (SELECT conv_id, turn, lower(tok) AS term, bool_or(regexp_matches(tok, '^\p{Lu}')) AS name FROM toks GROUP BY ALL),
        seen AS (SELECT *, min(CASE WHEN name THEN turn END) OVER (PARTITION BY conv_id, term) < turn AS cached FROM terms)
        SELECT conv_id, turn, count(*) AS n_words, count(*) FILTER (cached) AS n_cached FROM seen GROUP BY ALL""",
    "coref_nearest": f"""
        WITH {MENTIONS}, linked AS (SELECT *, turn - lag(turn) OVER (PARTITION BY conv_id, entity ORDER BY turn) AS distance FROM mentions)
        SELECT conv_id, turn, count(*) AS n, CAST(sum(distance) AS BIGINT) AS distance FROM linked WHERE distance <= 20 GROUP BY ALL""",
    "salience_decay": f"""
        WITH {MENTIONS}, weighted AS (SELECT conv_id, turn, entity, CASE WHEN place = 0 THEN 2.0 ELSE 1.0 END AS w FROM mentions)
        SELECT a.conv_id, a.turn, a.entity, round(sum(CAST(b.w AS DOUBLE) * pow(0.5, a.turn - b.turn)), 6) AS salience
        FROM weighted a JOIN weighted b ON a.conv_id = b.conv_id AND a.entity = b.entity AND b.turn <= a.turn GROUP BY ALL""",
    "modality_counts": r"""
        SELECT conv_id, count(*) AS turns, count(*) FILTER (contains(text, '?')) AS questions, count(*) FILTER (contains(text, '!')) AS exclamations,
            count(*) FILTER (regexp_matches(text, '(?i)\b(?:can|must|should|please|bitte|por favor)\b')) AS requests, count(*) FILTER (role = 'user') AS by_user
        FROM conversations GROUP BY conv_id""",
}
