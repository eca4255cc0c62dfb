import random
import time

import pytest
from pyspark.sql import functions as F

from glossa.operators import dependency, discourse, entities, frames, structure
from glossa.sources import jtab, kv, sexpr


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_sentences_and_phrases(spark):
    docs = spark.createDataFrame([(1, "The Cat of a king sat, on Mats. Next!\n\n"), (2, None), (3, "")], "doc_id long, text string")
    s = structure.sentences(docs)
    assert rows(s, "doc_id", "sent_no") == [(1, 0, "The Cat of a king sat, on Mats."), (1, 1, "Next!")]
    p = rows(structure.phrases(s).where("sent_no = 0"), "phrase_no")
    assert [(x[2], x[3], x[4], x[5], x[6]) for x in p] == [(0, 0, 1, "The", "The"), (1, 1, 3, "Cat", "a"), (2, 4, 3, "king", "on"), (3, 7, 1, "Mats.", "Mats.")]
    assert sum(x[4] for x in p) == 8  # phrases partition the tokens


def test_merge_runs_and_cancel(spark):
    df = spark.createDataFrame([(1, i, m) for i, m in enumerate(["n", "n", None, "n", "n", "n", "m"])], "d int, i int, m string")
    runs = lambda most: [r["run"] for r in structure.merge_runs(df, ["d"], ["i"], F.col("m"), most).orderBy("i").collect()]
    assert runs(None) == [1, 1, 2, 3, 3, 3, 4]
    assert runs(2) == [1, 1, 2, 3, 4, 5, 6]


def test_brackets(spark):
    df = spark.createDataFrame([(1, "a(b(c)d)e"), (2, "x)(y"), (3, "()"), (4, "plain")], "id int, t string")
    depth = {r[0]: tuple(r[1]) for r in df.select("id", structure.bracket_depths(F.col("t"), "(", ")")).collect()}
    assert depth == {1: (2, 0, 0), 2: (0, 0, -1), 3: (1, 0, 0), 4: (0, 0, 0)}
    parts = rows(structure.split_brackets(df, "id", "t"), "id", "part_no")
    assert parts == [(1, 0, "ae"), (1, 1, "b(c)d"), (2, 0, "x)"), (2, 1, "y"), (3, 0, ""), (3, 1, ""), (4, 0, "plain")]


def pairs_of(spark, *own):
    return spark.createDataFrame([(1, 0, a, b, "D") for a, b in own], "doc_id long, sent_no int, dependent int, governor int, type string")


def test_dependency_masks(spark):
    p = spark.createDataFrame([(1, 0, i, x) for i, x in enumerate("ab,cd")], "doc_id long, sent_no int, phrase_no int, last string")
    reach = dependency.with_barrier(p, F.col("last") == ",")
    assert [r["reach"] for r in reach.orderBy("phrase_no").collect()] == [2, 2, 4, 4, 4]
    c = dependency.candidates(reach, F.when(F.col("g_last") != "b", "D"))
    assert [(x[2], x[3]) for x in rows(c, "dependent", "governor")] == [(0, 2), (1, 2), (2, 3), (2, 4), (3, 4)]
    quotes = spark.createDataFrame([(1, 0, 1, 3)], "doc_id long, sent_no int, first int, last int")
    every = pairs_of(spark, *[(a, b) for a in range(5) for b in range(a + 1, 5)])
    kept = {(x[2], x[3]) for x in rows(dependency.mask_quotes(every, quotes), "dependent")}
    assert kept == {(0, 3), (0, 4), (1, 2), (1, 3), (2, 3), (3, 4)}
    found = dependency.correlatives(p.withColumnRenamed("phrase_no", "n"), F.col("last") == "b", F.col("last") == "c", "n", ["doc_id", "sent_no"])
    assert rows(found, "start") == [(1, 0, 1, 3)]
    kept = {(x[2], x[3]) for x in rows(dependency.mask_correlatives(every, found), "dependent")}
    assert (1, 3) in kept and (1, 2) not in kept and (2, 4) not in kept and (0, 2) not in kept and (0, 1) in kept


def test_governors_inside_the_row(spark):
    rng = __import__("random").Random(3)
    sents = [[(rng.randrange(3), rng.random() < 0.2) for _ in range(rng.randrange(1, 9))] for _ in range(60)]
    reach = lambda s, i: next((j for j in range(i + 1, len(s)) if s[j][1]), len(s) - 1)
    df = spark.createDataFrame([(k, [(n, c, reach(s, i)) for i, (n, c) in enumerate(s)]) for k, s in enumerate(sents)], "k int, ps array<struct<n: int, c: boolean, reach: int>>")
    kind = lambda p, g: F.when(g["n"] == 2, "D").when(p["n"] == g["n"], "P")
    fits = lambda s, i, j: "D" if s[j][0] == 2 else "P" if s[i][0] == s[j][0] else None
    found = df.select(
        "k", dependency.count_candidates("ps", kind, ("D", "P")).alias("c"), dependency.default_governors("ps", kind, 2).alias("g2"), dependency.default_governors("ps", kind, -1).alias("far"),
        dependency.relaxed_governors("ps", kind, lambda g: g["c"]).alias("r"), dependency.relaxed_governors("ps", kind, lambda g: F.lit(False)).alias("strict"),
    )
    for r in found.collect():
        s = sents[r["k"]]
        can = [[j for j in range(i + 1, reach(s, i) + 1) if fits(s, i, j)] for i in range(len(s))]
        assert r["g2"] == [c[:2][-1] if c else None for c in can] and r["far"] == [c[-1] if c else None for c in can]
        for t in r["c"]:
            own = [j - i for i, c in enumerate(can) for j in c if fits(s, i, j) == t["type"]]
            assert (t["n"], t["distance"]) == (len(own), sum(own))
        last = [reach(s, i) if not c and reach(s, i) > i else None for i, c in enumerate(can)]
        assert r["r"] == last and r["strict"] == [x if x == len(s) - 1 else None for x in last]
    assert sorted(map(tuple, dependency.links(found, F.col("g2"), ["k"]).collect()))[0][0] >= 0


def test_candidates_by_rule_are_those_of_pairs(spark):
    rng = random.Random(12)
    sents = [[(rng.choice([1, 1, 2, 3]), rng.random() < 0.25) for _ in range(rng.randint(1, 25))] for _ in range(40)]
    reach = lambda s, i: next((j for j in range(i + 1, len(s)) if s[j][1]), len(s) - 1)
    df = spark.createDataFrame([(k, [(n, reach(s, i)) for i, (n, _) in enumerate(s)]) for k, s in enumerate(sents)], "k int, ps array<struct<n: int, reach: int>>")
    kind = lambda p, g: F.when(g["n"] > 1, "D").when(p["n"] == g["n"], "P")
    rules = (("D", lambda g: g["n"] > 1, lambda p: F.lit(True)), ("P", lambda g: g["n"] == 1, lambda p: p["n"] == 1))
    for r in df.select(dependency.count_ruled("ps", rules).alias("a"), dependency.count_candidates("ps", kind, ("D", "P")).alias("b")).collect():
        assert r["a"] == r["b"]


def test_candidates_of_a_long_sentence_are_counted_without_pairs(spark):
    n, began = 60_000, time.monotonic()
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.struct(F.lit(2).alias("n"), F.lit(n - 1).alias("reach"))).alias("ps"))
    told = df.select(F.inline(dependency.count_ruled("ps", (("D", lambda g: g["n"] > 1, lambda p: F.lit(True)),)))).first()
    assert tuple(told) == ("D", n * (n - 1) // 2, (n - 1) * n * (n + 1) // 6) and time.monotonic() - began < 60


def test_pair_quotes_and_projectivity(spark):
    p = spark.createDataFrame([(1, 0, 0, 1, 0), (1, 0, 1, 1, 0), (1, 0, 2, 0, 1), (2, 0, 0, 0, 1), (2, 0, 1, 0, 0)], "doc_id long, sent_no int, phrase_no int, o int, c int")
    assert rows(dependency.pair_quotes(p, F.col("o"), F.col("c")), "doc_id", "first") == [(1, 0, 0, 2), (1, 0, 1, 2), (2, 0, 0, 0)]
    ok = dependency.is_projective(pairs_of(spark, (0, 3), (1, 2), (2, 3))).first()["projective"]
    bad = dependency.is_projective(pairs_of(spark, (0, 2), (1, 3), (2, 3))).first()["projective"]
    assert (ok, bad) == (True, False)


@pytest.mark.parametrize(("a", "b", "want"), [((0, 1), (2, 3), "before"), ((0, 2), (2, 3), "meets"), ((0, 3), (1, 2), "contains"), ((1, 2), (0, 3), "inside"), ((0, 2), (1, 3), "overlaps"), ((0, 1), (0, 1), "equal"), ((5, 6), (1, 2), "after")])
def test_interval_relation(spark, a, b, want):
    assert spark.range(1).select(dependency.interval_relation(*map(F.lit, (*a, *b)))).first()[0] == want


def test_discourse(spark):
    df = spark.createDataFrame([(1, 0, "Ann met Bob"), (1, 1, "he left"), (1, 2, "Ann slept"), (2, 0, "Ann")], "c int, t int, text string")
    m = discourse.mentions(df, "c", "t")
    assert rows(discourse.nearest_antecedent(m, "c", "t", 20).select("c", "t", "entity", "distance"), "c") == [(1, 2, "ann", 2)]
    assert discourse.nearest_antecedent(m, "c", "t", 1).count() == 0
    s = discourse.salience(m.withColumn("w", F.lit(1.0)), "c", "t", "entity", "w", reach=2)
    assert {(r["c"], r["t"], r["entity"]): r["salience"] for r in s.collect()}[1, 2, "ann"] == pytest.approx(1.25)
    a = spark.createDataFrame([(1, 5, 9, "car")], "c int, t int, a_id int, a_w string")
    b = spark.createDataFrame([(1, 1, 1, "car"), (1, 4, 2, "carriage"), (1, 4, 3, "cart"), (1, 5, 10, "car")], "c int, t int, b_id int, b_w string")
    best = discourse.asof_antecedent(a, b, "c", "t", [F.col("a_w") == F.col("b_w"), F.col("b_w").startswith(F.col("a_w"))], 3)
    assert rows(best, "a_id") == [(1, 9, 3, 1, 1)]


def test_entities(spark):
    tags = spark.createDataFrame([(1, 0, "A", "PERSON:head"), (1, 1, "B", "PERSON:tail"), (1, 2, "c", "OTHER"), (1, 3, "D", "DATE:single")], "s int, i int, surface string, label string")
    spans = entities.entity_spans(tags, ["s"], "i")
    assert rows(spans, "first") == [(1, 0, 1, "PERSON", "AB"), (1, 3, 3, "DATE", "D")]
    units = spark.createDataFrame([(1, 0, 0, 2), (1, 1, 3, 3)], "s int, unit_no int, first int, last int")
    assert rows(entities.entities_to_units(spans, units, ["s"]), "unit_no") == [(1, 0, "PERSON", "AB"), (1, 1, "DATE", "D")]
    seen = spark.createDataFrame([(1, 0, "x", "PERSON"), (1, 1, "x", "OTHER"), (2, 0, "x", "DATE")], "a int, o int, w string, label string")
    assert [r["cached"] for r in entities.cached_label(seen, "a", "o", "w", "label").orderBy("a", "o").collect()] == [None, "PERSON", None]
    main = spark.createDataFrame([("s-1", "a\u0001b\u0001"), ("s-2", "c")], "sent_id string, text string")
    parts = spark.createDataFrame([("s-1-02", "(y)"), ("s-1-01", "(x)")], "sent_id string, text string")
    assert rows(entities.merge_parentheses(main, parts), "sent_id") == [("s-1", "a(x)b(y)"), ("s-2", "c")]


def test_frame_lookup(spark):
    predicates = spark.createDataFrame([(1, "eat", "active", "apple"), (2, "eat", "passive", "x"), (3, "zzz", "active", "x")], "id int, predicate string, voice string, nearest string")
    known = spark.createDataFrame([("f1", "apple:eat", "active"), ("f2", "eat", "active"), ("f0", "*", "active")], "frame_id string, predicate string, voice string")
    assert rows(frames.lookup_frames(predicates, known).select("id", "f_frame_id"), "id") == [(1, "f1"), (2, "f2"), (3, "f0")]
    sim = spark.createDataFrame([(True, 0.1, False, False), (False, 0.5, True, False), (False, None, False, False)], "e boolean, c double, a boolean, k boolean")
    assert [r[0] for r in sim.select(frames.slot_similarity(*map(F.col, "ecak"))).collect()] == [11.0, 8.0, 0.0]


RECORD = """# S-ID:art-1-7 note
* 1D <a><b:c>
+ 1D <x>
猫 ねこ 猫 名詞 6 普通名詞 1 * 0 * 0 "代表表記:猫/ねこ" <f><g:1>
が が が 助詞 9 格助詞 1 * 0 * 0 NIL
* -1D
+ -1D
@ @ @ 特殊 1 記号 5 * 0 * 0 NIL
走る はしる 走る 動詞 2 * 0 子音動詞ラ行 10 基本形 2 "q\\"r"
@ 奔る はしる 奔る 動詞 2 * 0 子音動詞ラ行 10 基本形 2 NIL
EOS
"""


def test_jtab_record():
    r = jtab.parse_record(RECORD.removesuffix("EOS\n"))
    assert (r["article_id"], r["sent_no"], r["comment"]) == ("art-1", 7, "note")
    assert [p["features"] for p in r["phrases"]] == [["a", "b:c"], []]
    assert [m["surface"] for m in r["morphemes"]] == ["猫", "が", "@", "走る", "奔る"]
    assert r["morphemes"][4]["alternative_of"] == 3 and r["morphemes"][3]["sem"] == 'q"r' and r["morphemes"][0]["features"] == ["f", "g:1"]
    assert jtab.parse_record(jtab.format_record(r).removesuffix("EOS\n")) == r
    bad = jtab.parse_record("# S-ID:a-1\n猫 ねこ\n")
    assert bad["error"] and bad["morphemes"] == [] and bad["sent_id"] == "a-1"
    assert jtab.parse_record("") is None and jtab.parse_record("! x\n", "!") is None


def test_jtab_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jtab").write_text(RECORD + "# S-ID:b-1\nbroken\nEOS\n" + RECORD.replace("art-1-7", "b-2"))
    back = jtab.read_jtab(spark, str(tmp_path / "in"))
    assert [r["sent_id"] for r in back.orderBy("sent_id").collect()] == ["art-1-7", "b-1", "b-2"]
    tables = jtab.to_tables(back)
    assert tables["morphemes"].count() == 10 and tables["phrases"].count() == 4 and tables["sentences"].where("error IS NOT NULL").count() == 1
    jtab.write_jtab(back.where("error IS NULL"), str(tmp_path / "out"))
    assert jtab.read_jtab(spark, str(tmp_path / "out")).count() == 2
    spark.dataSource.register(jtab.JtabDataSource)
    by_name = spark.read.format("jtab").load(str(tmp_path / "in"))
    assert by_name.count() == 3
    by_name.where("error IS NULL").write.format("jtab").mode("append").save(str(tmp_path / "named"))
    assert spark.read.format("jtab").load(str(tmp_path / "named")).count() == 2
    by_name.where("sent_id = 'b-2'").write.format("jtab").mode("overwrite").save(str(tmp_path / "named"))
    assert [r["sent_id"] for r in spark.read.format("jtab").load(str(tmp_path / "named")).collect()] == ["b-2"]
    assert all(f.name.startswith("part-") for f in (tmp_path / "named").iterdir())
    assert [r["sent_id"] for r in jtab.look_up(back, ["b-2"]).collect()] == [r["sent_id"] for r in jtab.look_up(back, spark.createDataFrame([("b-2",)], "sent_id string")).collect()] == ["b-2"]
    from glossa.operators.units import given_units

    assert rows(given_units(back.where("sent_id = 'b-2'")), "unit_no") == [("b-2", 0, 0, 0, 1), ("b-2", 1, 1, 2, 3)]


def test_jtab_files_may_be_compressed_and_bounded(spark, tmp_path):
    (tmp_path / "a.jtab").write_text(RECORD + "# S-ID:b-1\nbroken\nEOS\n" + RECORD.replace("art-1-7", "b-2"))
    records = jtab.read_jtab(spark, str(tmp_path / "a.jtab"))
    jtab.write_jtab(records, str(tmp_path / "out"), "gzip", 1)
    assert len(list((tmp_path / "out").glob("*.gz"))) == 3
    rows = lambda df: sorted(map(str, df.drop("error").collect()))
    assert rows(jtab.read_jtab(spark, str(tmp_path / "out"))) == rows(records)


def test_jtab_writer_keeps_only_what_counts(tmp_path):
    from pyspark.sql import Row

    row = Row(sent_id="s-1", comment=None, error=None, phrases=[], basic_phrases=[], morphemes=[])
    writer = jtab.JtabWriter({"path": str(tmp_path / "out")}, False)
    first, again = writer.write(iter([row])), writer.write(iter([row]))  # a task that ran twice
    writer.commit([again, None])
    assert [f.name for f in (tmp_path / "out").iterdir()] == [again.file] and first.file != again.file
    other = jtab.JtabWriter({"path": str(tmp_path / "out")}, False)
    other.write(iter([row]))
    other.abort([None])
    assert [f.name for f in (tmp_path / "out").iterdir()] == [again.file]


def test_gold_relations(spark):
    units = [(0, 1, "D", ["rel:ga:cat:s-1:0", "x"]), (0, -1, "D", ["rel:wo:reader", "rel::bad"])]
    df = spark.createDataFrame([("s-2", units)], "sent_id string, basic_phrases array<struct<phrase_no: int, head: int, dep_type: string, features: array<string>>>")
    assert rows(jtab.gold_relations(df), "bp_no") == [("s-2", 0, "ga", "cat", "s-1", 0), ("s-2", 1, "wo", "reader", None, None)]


def test_result_header_and_trees(spark):
    from glossa.operators.chart import draw, to_sexp
    from glossa.sources import sinks

    df = spark.createDataFrame([("s-1", "note", None, -1.5, "slow", None), ("s-2", None, "bad", None, None, "m")], "sent_id string, comment string, error string, p double, w string, memo string")
    assert rows(sinks.result_header(df, "p", "w", "memo"), "sent_id") == [("s-1", "# S-ID:s-1 note SCORE:-1.50000 WARNING:slow"), ("s-2", "# S-ID:s-2 ERROR:bad MEMO:m")]
    trees = spark.createDataFrame([(1, ["a", "b", "c"], [2, 2, -1]), (2, [], [])], "id int, words array<string>, heads array<int>")
    assert rows(sinks.trees_text(trees, ["id"]), "id") == [(1, draw(["a", "b", "c"], [2, 2, -1]), to_sexp(["a", "b", "c"], [2, 2, -1])), (2, "", "()")]


def test_sexpr():
    assert list(sexpr.read('(a "b c" (d)) ; note\n(e)')) == [["a", "b c", ["d"]], ["e"]]
    assert sexpr.write(["a", "b c", ["d"]]) == '(a "b c" (d))'
    for bad in ("(a", "a)"):
        with pytest.raises(ValueError):
            list(sexpr.read(bad))
    own = sexpr.lexicon("(noun (common ((surface a b) (reading r) (weight 2) (sem s))))")
    assert [(r["surface"], r["reading"], r["weight"], r["pos"], r["subpos"]) for r in own] == [("a", "r", 2.0, "noun", "common"), ("b", "r", 2.0, "noun", "common")]
    assert sexpr.connections("((1 2) (3) 5)") == [([1, 2], [3], 5.0)]
    rule = sexpr.rules('(? "[pos=N]" ? (hit))')[0]
    assert rule.left is None and rule.right is None and rule.actions == ("hit",)


def test_kv(spark):
    df = spark.createDataFrame([("a", "01", 2), ("a", "11", 1), ("b", "10", 1)], "key string, value string, o int")
    got = lambda policy: dict(rows(kv.bulk_load(df, policy, "o"), "key"))
    assert got("append") == {"a": "11/01", "b": "10"} and got("or") == {"a": "11", "b": "10"} and got("and") == {"a": "01", "b": "10"}
    assert got("first") == {"a": "11", "b": "10"} and got("last") == {"a": "01", "b": "10"}
    assert rows(kv.look_up(spark.createDataFrame([("a",), ("z",)], "key string"), kv.bulk_load(df, "first", "o")), "key") == [("a", "11"), ("z", None)]


def test_stream_context_state():
    from glossa.streaming.context import Context

    c = Context()
    assert c.see(0, "Ann met Bob", 0.5, 100) == (3, 0, "bob", 1.0, False)
    c = Context(c.dump())
    assert c.see(2, "Ann slept", 0.5, 100) == (2, 1, "ann", 1.25, False)
    assert c.see(3, "a b c", 0.5, 3)[4] and c.words == {}


def test_sinks(spark, tmp_path):
    from glossa.sources import sinks

    (tmp_path / "a.jtab").write_text(RECORD + "# S-ID:b-1\nbroken\nEOS\n")
    records = jtab.read_jtab(spark, str(tmp_path))
    tables = jtab.to_tables(records)
    assert rows(sinks.phrase_lines(tables["phrases"], ["sent_id"]), "sent_id") == [("art-1-7", "* 1D <a><b:c>\n* -1D")]
    text = sinks.morpheme_lines(tables["morphemes"], ["sent_id"], False).first()["text"]
    assert text.split("\n")[1] == "が が が 助詞 9 格助詞 1 * 0 * 0 NIL" and "<f>" not in text
    assert "<f><g:1>" in sinks.morpheme_lines(tables["morphemes"], ["sent_id"]).first()["text"]
    xml = dict(rows(sinks.records_to_xml(records), "sent_id"))
    import xml.etree.ElementTree as ET

    tree = ET.fromstring(xml["art-1-7"])
    assert [p.get("head") for p in tree] == ["1", "-1"] and [w.get("surface") for w in tree.iter("word")] == ["猫", "が", "@", "走る"]
    assert "ERROR:" in dict(rows(sinks.error_header(records), "sent_id"))["b-1"]
    slots = spark.createDataFrame([(1, 2, "eat", "ga", "cat", True), (1, 2, "eat", "wo", "fish", False), (1, 2, "eat", "ni", None, False)], "s int, predicate int, word string, slot string, filler string, overt boolean")
    assert rows(sinks.predicate_arguments(slots, ["s"]), "s") == [(1, 2, "eat ga:cat ni:- wo:[fish]")]
    assert sinks.table_text(slots, ["s"], "slot", ["slot", "filler"]).first()["text"] == "slot\tfiller\nga\tcat\nni\t\nwo\tfish"


def test_reach_inside_the_row_equals_the_window(spark):
    texts = ["A, B of C, D E, the F", "of, A", "A B C", "A,", "A, B,", "of the A, B"]
    sents = structure.sentences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    comma = lambda c: c.endswith(",")
    inside = structure.phrases(sents, barrier=comma)
    window = dependency.with_barrier(structure.phrases(sents), comma(F.col("last")))
    columns = ["doc_id", "sent_no", "phrase_no", "reach"]
    assert rows(inside.select(columns), *columns) == rows(window.select(columns), *columns)


def test_jtab_arrays_are_the_records_line_by_line(spark):
    import pyarrow as pa

    plain = "# S-ID:b-2 note\n" + "".join(f"{w} {w} {w} noun 6 * 0 * 0 * 0 {r}\n" for w, r in (("#", "NIL"), ("*", '"x y" <a>'), ("@", "<a><b:\\>c>"), ("a\u3000b\xa0", "NIL")))
    texts = [RECORD.removesuffix("EOS\n"), plain, plain.split("\n", 1)[1], "# S-ID:c-1\nbroken\n", "# only", "", "! x\n" + plain, "a a a n 1 * 0 * 0 * 0\n@ b b b n 1 * 0 * 0 * 0 NIL", "# a\n# S-ID:d-4\nx x x n 1 * 0 * 0 * 0"]
    found = sorted((r for b in jtab.parse_records(pa.array(texts), "!") for r in b.to_pylist()), key=str)
    wanted = sorted((r for t in texts if (r := jtab.parse_record(t, "!"))), key=str)
    assert found == wanted and [m["surface"] for m in jtab.parse_record(plain)["morphemes"]] == ["#", "*", "@", "a\u3000b\xa0"]
    batch = pa.RecordBatch.from_pylist(wanted, schema=jtab.arrow_schema())
    assert sorted(jtab.format_records(batch).to_pylist()) == sorted(jtab.format_record(r).removesuffix("\n") for r in wanted)


def test_jtab_plain_records_are_not_handled_one_by_one(monkeypatch):
    import pyarrow as pa

    def refuse(*_):
        raise AssertionError("record by record")

    monkeypatch.setattr(jtab, "parse_record", refuse)
    monkeypatch.setattr(jtab, "format_record", refuse)
    text = "# S-ID:b-2\n" + "w w w noun 6 * 0 * 0 * 0 NIL\n" * 3
    (batch,) = jtab.parse_records(pa.array([text] * 5))
    assert jtab.format_records(batch).to_pylist() == [text + "EOS"] * 5


def test_units_ask_each_test_once(spark):
    from pyspark.sql import functions as F

    from glossa.operators import units

    asked = []

    def test(name, *words):
        def run(m):
            asked.append(name)
            return m.isin(*words)

        return run

    content = test("content", "C", "D")
    df = spark.createDataFrame([(1, ["x", "p", "C", "s", "u", "D", ",", "p"]), (2, []), (3, ["D"])], "id int, ms array<string>")
    made = units.unit_arrays(df, ["id"], "ms", phrase=content, unit=test("unit", "u"), prefix=test("prefix", "p"), content=content, semi=test("semi", ","))
    assert sorted(asked) == ["content", "prefix", "semi", "unit"]  # each was asked in several places before
    got = [tuple(r) for r in made.select("id", F.inline("us")).orderBy("id", "first").collect()]
    assert got == [(1, 0, 0, 1, 1, 0, 1, 0), (1, 1, 2, 3, 0, 1, 1, 2), (1, 1, 4, 4, 0, 0, 1, 4), (1, 2, 5, 7, 1, 1, 1, 6), (3, 0, 0, 0, 0, 1, 0, 0)]
