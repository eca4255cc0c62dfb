"""Catalogue queries that run a kernel; those that SQL can state are checked by SQL, the rest by tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.operators.structure import is_function, phrase_arrays, sentences, tokens
from glossa.plans.session import scratch_dir, table


def _conversation_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("doc_id"), "text")
    return sentences(rows)


def _document_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(table(spark, sf_dir, "documents").select("doc_id", "text"))


def jtab_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of documents written as analysed text and read again."""
    from glossa.sources.jtab import read_jtab, write_jtab

    sents = sentences(table(spark, sf_dir, "documents"))
    ts = tokens(F.col("sentence"))
    morpheme = lambda t: F.struct(
        *[t.alias(c) for c in ("surface", "reading", "lemma")], F.when(is_function(t), "particle").otherwise("noun").alias("pos"), F.lit(1).alias("pos_id"),
        *[x.alias(c) for c in ("subpos", "infl_type", "infl_form") for x in (F.lit("*"),)], *[F.lit(0).alias(c) for c in ("subpos_id", "infl_type_id", "infl_form_id")],
        F.lit(None).cast("string").alias("sem"), F.array().cast("array<string>").alias("features"), F.lit(-1).alias("phrase_no"), F.lit(-1).alias("bp_no"), F.lit(None).cast("int").alias("alternative_of"),
    )
    unit = "array<struct<phrase_no: int, head: int, dep_type: string, features: array<string>>>"
    records = sents.select(
        F.col("doc_id").cast("string").alias("article_id"), F.concat_ws("-", F.col("doc_id").cast("string"), F.col("sent_no").cast("string")).alias("sent_id"), "sent_no",
        F.lit(None).cast("string").alias("comment"), F.array().cast(unit).alias("phrases"), F.array().cast(unit).alias("basic_phrases"), F.transform(ts, morpheme).alias("morphemes"), F.lit(None).cast("string").alias("error"),
    )
    folder = scratch_dir(spark)
    write_jtab(records, folder, "gzip", 100_000)  # as plain text they take twelve times what the documents do
    back = read_jtab(spark, folder).select("sent_id", F.transform("morphemes", lambda m: m["surface"]).alias("ms")).where(F.size("ms") > 0)
    doc, number = F.regexp_extract("sent_id", "^(.*)-", 1).cast("long").alias("doc_id"), F.regexp_extract("sent_id", "-([0-9]+)$", 1).cast("long").alias("sent_no")
    return back.select(doc, number, F.size("ms").cast("long").alias("n_morphemes"), F.md5(F.array_join("ms", " ")).alias("surfaces"))


def crf_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labeller of capitalised words, trained on fixed sentences, over all documents."""
    from glossa.operators import crf

    data = [([[w] for w in s.split()], ["N" if w[0].isupper() else "O" for w in s.split()]) for s in ("The cat sat on a Mat", "we saw Anna in Rome", "of the and to in", "Then Bob went", "it is Late")]
    f = crf.Features.build(["U0:%x[0,0]", "B"], data)
    w = crf.train(f, data)
    rows = _document_sentences(spark, sf_dir).select("doc_id", "sent_no", tokens(F.col("sentence")).alias("tokens"))
    tagged = crf.tag(rows, ["doc_id", "sent_no"], f, w)
    return tagged.select("doc_id", "sent_no", F.size("tags").alias("n"), F.size(F.filter("tags", lambda t: t == "N")).alias("n_names"))


def viterbi_ne(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of documents: label scores by shape, legal labels by constrained decoding, spans inside the row."""
    import numpy as np

    from glossa.operators import crf
    from glossa.operators.entities import entity_arrays

    at = {x: i for i, x in enumerate(crf.ENTITY_LABELS)}

    @F.arrow_udf("array<string>")
    def run(sentences):
        import pyarrow as pa

        sizes = np.array(sentences.value_lengths().fill_null(0))
        ends = np.r_[0, sizes.cumsum()]
        flat, labels, row = sentences.flatten(), [], 0
        while row < len(sizes):  # as many sentences as have HELD tokens, one at least
            last = max(row + 1, int(np.searchsorted(ends, ends[row] + crf.HELD, "right")) - 1)
            ts = flat.slice(ends[row], ends[last] - ends[row]).to_pylist()
            p = np.full((len(ts), len(at)), 0.001)
            p[:, at["OTHER"]] = 0.5
            name = np.fromiter((t[:1].isupper() for t in ts), bool, len(ts))
            name[ends[row:last][sizes[row:last] > 0] - ends[row]] = False
            p[np.ix_(name, [at[f"PERSON:{place}"] for place in crf.PLACES])] = 0.6
            p[np.fromiter((t[:1].isdigit() for t in ts), bool, len(ts)), at["DATE:single"]] = 0.9
            labels.append(pa.array(crf.decode_entities_many(p, sizes[row:last]), pa.string()))
            row = last
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.concat_arrays(labels) if labels else pa.array([], pa.string()))

    rows = _document_sentences(spark, sf_dir).select("doc_id", "sent_no", tokens(F.col("sentence")).alias("tokens"))
    # outer: from the plain form Catalyst infers a filter on the array, and computes it once more
    tagged = rows.select("doc_id", "sent_no", "tokens", run("tokens").alias("labels"))
    found = tagged.select("doc_id", "sent_no", F.explode_outer(entity_arrays("tokens", "labels")).alias("e"))
    return found.where("e IS NOT NULL").select("doc_id", "sent_no", "e.*")


def _parsed(spark: SparkSession, sf_dir: str, wanted: Column | None = None) -> DataFrame:
    """A row for each sentence, or each wanted one (a condition on the text), dealt out anew: the kernels take long over a few long sentences."""
    field = lambda make: F.transform("ps", make)
    case = lambda p, i: F.when(i == 0, "topic").when(p["n_tok"] == 2, "subject").when(p["n_tok"] == 3, "object")
    sents = _document_sentences(spark, sf_dir)
    rows = phrase_arrays(sents if wanted is None else sents.where(wanted)).select(
        "doc_id", "sent_no", field(case).alias("cases"), field(lambda p: p["last"].endswith(",")).alias("commas"), field(lambda p: p["n_tok"] > 1).alias("predicates"), field(lambda p: p["head"]).alias("words")
    )
    # a number of tasks that is given is not lowered to what the bytes of the rows call for
    return rows.repartition(8 * spark.sparkContext.defaultParallelism, "doc_id", "sent_no")


def cky_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependency trees of all sentences of the documents; those that fell back to the chain are marked."""
    from glossa.operators.chart import parse_sentences

    return parse_sentences(_parsed(spark, sf_dir), ["doc_id", "sent_no"], seconds=180.0)


def coord_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordination scopes of the phrases before a comma, in documents."""
    import numpy as np

    from glossa.operators.coordination import Marks, consistent_many

    schema = "doc_id long, sent_no int, start int, key int, end int, score double, status string"

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.r_[0, np.cumsum(batch["words"].value_lengths().to_numpy())]
            words = batch["words"].flatten().dictionary_encode()
            known: dict[str, int] = {}
            codes = np.array([known.setdefault(w.lower(), len(known)) for w in words.dictionary.to_pylist()], np.intp)[words.indices.to_numpy()]
            flags = {c: batch[c].flatten().to_numpy(zero_copy_only=False) for c in ("commas", "predicates")}
            marks = Marks(list(known), codes, flags["predicates"], flags["commas"].astype(np.int32) - 1)
            keys = [np.flatnonzero(flags["commas"][i : j - 1]).tolist() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            found = consistent_many(marks, np.diff(at).tolist(), keys)
            of = np.array([i for i, _ in found], np.int64)
            columns = [batch["doc_id"].take(pa.array(of)), batch["sent_no"].take(pa.array(of))]
            columns += [pa.array([getattr(x, c) for _, x in found], pa.int32()) for c in ("start", "key", "end")]
            columns += [pa.array([round(x.score, 6) for _, x in found], pa.float64()), pa.array([x.status for _, x in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "sent_no", "start", "key", "end", "score", "status"])

    # a condition on the phrases would be pushed down to the sentences, and their arrays computed once more for each phrase
    return _parsed(spark, sf_dir, F.col("sentence").contains(",")).mapInArrow(run, schema)


def lattice_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations segmented by a lexicon of their short words and by the classes of unknown ones."""
    from glossa.operators.lattice import Grammar, Word, segment

    lexicon = [Word(w, w, "Function", weight=0.5) for w in ("the", "of", "and", "to", "in", "is", "de", "la", "der", "die", "el", "que")]
    rows = _conversation_sentences(spark, sf_dir).select(F.concat_ws(":", "doc_id", F.col("sent_no").cast("string")).alias("sent_id"), "sentence")
    return segment(rows, "sent_id", "sentence", lexicon, Grammar({"Function": 5.0, "Space": 1.0, "Symbol": 10.0, "Number": 10.0, "Unknown": 20.0}))


def zero_anaphora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as articles: capitalised words are nouns, the last word of a sentence is a predicate with a subject
    and an object to find."""
    from glossa.operators.anaphora import resolve_articles

    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("int").alias("sentence"), F.regexp_extract_all("text", F.lit(r"\p{Lu}\p{L}+"), F.lit(0)).alias("names"))
    noun = F.transform("names", lambda w, i: F.struct(i.alias("phrase"), F.lower(w).alias("word"), F.when(i == 0, "topic").otherwise("object").alias("role"), F.lit("PERSON").alias("kind"), F.lit(False).alias("predicate"), F.array().cast("array<string>").alias("slots"), F.size("names").alias("head")))
    verb = F.array(F.struct(F.size("names").alias("phrase"), F.lit("say").alias("word"), F.lit("").alias("role"), F.lit("").alias("kind"), F.lit(True).alias("predicate"), F.array(F.lit("subject"), F.lit("object"), F.lit("dative")).alias("slots"), F.lit(-1).alias("head")))
    return resolve_articles(rows.select("conv_id", "sentence", F.explode(F.concat(noun, verb)).alias("p")).select("conv_id", "sentence", "p.*"), "conv_id")


def stream_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as a stream, their context as keyed state, drained to a table."""
    from glossa.streaming.context import article_context, run_to_end

    schema = table(spark, sf_dir, "conversations").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/conversations.parquet*")
    folder = scratch_dir(spark)
    run_to_end(article_context(stream, "conv_id", "turn", "text", timeout=""), folder)
    return spark.read.parquet(f"{folder}/out").select("conv_id", "turn", "n_words", "n_seen", "entity", F.round("salience", 6).alias("salience"), "late", "reset")


QUERIES = {f.__name__: f for f in (jtab_roundtrip, crf_tag, viterbi_ne, cky_parse, coord_scope, lattice_segment, zero_anaphora, stream_context)}

ORACLES = {
    "jtab_roundtrip": r"""
        WITH lists AS (
            SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?\n]+[.!?]*'), lambda s: trim(s)), lambda s: s <> '') AS ss FROM documents
        ),
        sents AS (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM lists),
        toks AS (SELECT doc_id, i - 1 AS sent_no, regexp_extract_all(s, '[^ \t\r\n]+') AS ts FROM sents)
        SELECT doc_id, CAST(sent_no AS BIGINT) AS sent_no, CAST(len(ts) AS BIGINT) AS n_morphemes, md5(array_to_string(ts, ' ')) AS surfaces FROM toks WHERE len(ts) > 0""",
    "viterbi_ne": r"""
        WITH lists AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?\n]+[.!?]*'), lambda s: trim(s)), lambda s: s <> '') AS ss FROM documents),
        sents AS (SELECT doc_id, regexp_extract_all(unnest(ss), '[^ \t\r\n]+') AS ts, generate_subscripts(ss, 1) - 1 AS sent_no FROM lists),
        toks AS (SELECT doc_id, sent_no, unnest(ts) AS t, generate_subscripts(ts, 1) - 1 AS i FROM sents),
        caps AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, sent_no ORDER BY i) AS run FROM toks WHERE i > 0 AND regexp_matches(t, '^\p{Lu}')),
        -- of equal scores the first is kept: a run of names is cut into pairs from its end
        pairs AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, sent_no, run ORDER BY i DESC) - 1) // 2 AS pair FROM caps),
        spans AS (
            SELECT doc_id, sent_no, min(i) AS f, max(i) AS l, 'PERSON' AS kind, string_agg(t, '' ORDER BY i) AS text FROM pairs GROUP BY doc_id, sent_no, run, pair
            UNION ALL SELECT doc_id, sent_no, i, i, 'DATE', t FROM toks WHERE regexp_matches(t, '^\p{Nd}')
        )
        SELECT doc_id, CAST(sent_no AS INTEGER) AS sent_no, CAST(f AS INTEGER) AS "first", CAST(l AS INTEGER) AS "last", kind, text FROM spans""",
    "lattice_segment": r"""
        WITH lists AS (SELECT conv_id, turn, list_filter(list_transform(regexp_extract_all(text, '[^.!?\n]+[.!?]*'), lambda s: trim(s)), lambda s: s <> '') AS ss FROM conversations),
        sents AS (SELECT concat(conv_id, '-', turn, ':', generate_subscripts(ss, 1) - 1) AS sent_id, regexp_extract_all(unnest(ss), '\p{Nd}+|\p{L}[.\p{L}]*|(?s:.)') AS rs FROM lists),
        runs AS (SELECT sent_id, unnest(rs) AS run, generate_subscripts(rs, 1) AS i FROM sents),
        words AS (SELECT unnest(['the', 'of', 'and', 'to', 'in', 'is', 'de', 'la', 'der', 'die', 'el', 'que']) AS w),
        ends AS (SELECT w FROM words UNION ALL SELECT '.'),
        cuts AS (SELECT a.w || b.w AS run, [a.w, b.w] AS parts FROM words a, ends b),
        pieces AS (SELECT sent_id, i, unnest(coalesce(c.parts, [r.run])) AS surface, unnest([1, 2]) AS k FROM runs r LEFT JOIN cuts c ON c.run = r.run),
        posed AS (
            SELECT sent_id, surface, i, k, CASE WHEN surface IN (SELECT w FROM words) THEN 'Function' WHEN surface = ' ' THEN 'Space' WHEN regexp_matches(surface, '^\p{Nd}') THEN 'Number'
                WHEN regexp_matches(surface, '^\p{L}') THEN 'Unknown' ELSE 'Symbol' END AS pos
            FROM pieces WHERE surface IS NOT NULL
        )
        SELECT sent_id, CAST(row_number() OVER w - 1 AS INTEGER) AS morph_no, surface, surface AS lemma, pos, CAST(coalesce(sum(length(surface)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start,
            CAST(sum(CASE pos WHEN 'Function' THEN 42.5 WHEN 'Space' THEN 41 WHEN 'Unknown' THEN 100 ELSE 50 END) OVER w AS DOUBLE) AS cost
        FROM posed WINDOW w AS (PARTITION BY sent_id ORDER BY i, k)""",
    "stream_context": r"""
        WITH toks AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(lower(text), '[^ \t\r\n]+')) AS w FROM conversations),
        seen AS (SELECT *, min(turn) OVER (PARTITION BY conv_id, w) < turn AS old FROM toks),
        counts AS (SELECT conv_id, turn, count(*) AS n_words, count(*) FILTER (old) AS n_seen FROM seen GROUP BY ALL),
        turns AS (SELECT conv_id, turn FROM conversations),
        names AS (SELECT DISTINCT conv_id, turn, lower(unnest(regexp_extract_all(text, '\p{Lu}\p{L}+'))) AS e FROM conversations),
        scores AS (SELECT t.conv_id, t.turn, n.e, sum(pow(0.5, t.turn - n.turn)) AS s FROM turns t JOIN names n ON n.conv_id = t.conv_id AND n.turn <= t.turn GROUP BY ALL),
        best AS (SELECT conv_id, turn, e, s, row_number() OVER (PARTITION BY conv_id, turn ORDER BY round(s, 9) DESC, e DESC) AS r FROM scores)
        SELECT t.conv_id, t.turn, coalesce(n_words, 0) AS n_words, coalesce(n_seen, 0) AS n_seen, b.e AS entity, round(coalesce(b.s, 0.0), 6) AS salience, false AS late, false AS reset
        FROM turns t LEFT JOIN counts c ON c.conv_id = t.conv_id AND c.turn = t.turn LEFT JOIN best b ON b.conv_id = t.conv_id AND b.turn = t.turn AND b.r = 1""",
}
