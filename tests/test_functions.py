import pytest
from pyspark.sql import functions as F

from glossa.functions import chars, features, probability, similarity


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(0).alias("_")).select(column).first()[0]


def feats(spark, column, *own):
    return spark.createDataFrame([(list(own),)], "f array<string>").select(column).first()[0]


def test_feature_match_put_drop(spark):
    f = F.col("f")
    assert feats(spark, features.has(f, "case"), "case:ga", "cased")
    assert not feats(spark, features.has(f, "cas"), "case:ga")
    assert feats(spark, features.value(f, "case"), "x", "case:ga", "case:wo") == "ga"
    assert feats(spark, features.put(f, "case:ni"), "a", "case:ga", "b") == ["a", "case:ni", "b"]
    assert feats(spark, features.put(f, "new:1"), "a") == ["a", "new:1"]
    assert feats(spark, features.drop(f, "case"), "a", "case:ga", "case") == ["a"]
    assert feats(spark, features.drop_temporary(f), "a", "T-x") == ["a"]
    assert feats(spark, features.name_of(F.get(f, 0)), '"a:b":c') == '"a:b"'
    assert feats(spark, features.without_last_field(F.get(f, 0)), "a:b:c") == "a:b"


@pytest.mark.parametrize(
    ("pattern", "want"),
    [([], True), ([["a"]], True), ([["^a"]], False), ([["a", "z"], ["b", "^z"]], True), ([["z"]], False), ([["&long:1"]], True)],
)
def test_dnf(spark, pattern, want):
    functions = {"long": lambda n: F.size("f") > int(n)}
    assert feats(spark, features.dnf(F.col("f"), pattern, functions), "a", "b:1") is want


@pytest.mark.parametrize(
    ("text", "want"),
    [("漢字", "kanji"), ("ひらー", "hiragana"), ("カタカナ", "katakana"), ("123", "digit"), ("abc", "letter"), ("、。", "symbol"), ("漢じ", "kana_kanji"), ("a1", "mixed"), ("", "none")],
)
def test_char_class(spark, text, want):
    assert one(spark, chars.char_class(F.col("t")), t=text) == want


def test_conversions_and_affixes(spark):
    assert one(spark, chars.to_hiragana(F.col("t")), t="カナx") == "かなx"
    assert one(spark, chars.to_katakana(F.col("t")), t="かな") == "カナ"
    assert one(spark, chars.to_half_width(F.col("t")), t="Ａ１　") == "A1 "
    assert one(spark, chars.to_full_width(F.col("t")), t="A1 ") == "Ａ１　"
    assert one(spark, chars.common_prefix(F.col("a"), F.col("b")), a="abcd", b="abxd") == 2
    assert one(spark, chars.common_suffix(F.col("a"), F.col("b")), a="abcd", b="xbcd") == 3
    assert one(spark, chars.in_category(F.col("a"), "y"), a="x;y;z")
    assert one(spark, chars.level_at_least(F.col("a"), F.col("b")), a="B+", b="B")
    assert one(spark, chars.level_at_least(F.lit(None).cast("string"), F.col("b")), b="B")


def test_similarity(spark):
    pair = spark.createDataFrame([(["a", "b", "c", "d"], ["b", "c", "d"], [["1", "2"], ["9"]], [["1", "2", "3"]])], "a array<string>, b array<string>, x array<array<string>>, y array<array<string>>")
    assert pair.select(similarity.distributional(F.col("a"), F.col("b"))).first()[0] == pytest.approx((3 / 4 + 1) / 2)
    assert pair.select(similarity.distributional(F.col("a"), F.array(F.lit("b"), F.lit("c")))).first()[0] == 0
    assert pair.select(similarity.best_code_similarity(F.col("x"), F.col("y"))).first()[0] == pytest.approx(4 / 5)
    table = spark.createDataFrame([("a", "b", 0.5), ("a", "c", 0.1)], "w1 string, w2 string, sim double")
    pairs = spark.createDataFrame([("b", "a"), ("a", "c"), ("x", "y")], "w1 string, w2 string")
    got = {r["w1"]: r["similarity"] for r in similarity.with_table(pairs, table, F.lit(0.7)).collect()}
    assert got == {"b": 0.5, "a": 0.0, "x": 0.7}


def test_probability(spark):
    import math

    assert one(spark, probability.floored_log(F.col("p")), p=0.0) == pytest.approx(math.log(1e-6))
    assert one(spark, probability.interpolated(F.col("a"), F.col("d"), F.col("b")), a=0.5, d=3, b=0.1) == pytest.approx(0.75 * 0.5 + 0.25 * 0.1)
    assert one(spark, probability.unfilled(F.col("p")), p=0.25) == pytest.approx(math.log(0.75))
    rows = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "k1 string, k2 string").withColumn("any", F.lit("*"))
    table = spark.createDataFrame([("a|x", 1.0), ("x", 2.0), ("*", 3.0)], "key string, p double")
    got = {r["k1"]: (r["p"], r["level"]) for r in probability.backoff(rows, table, [["k1", "k2"], ["k2"], ["any"]], "p").collect()}
    assert got == {"a": (1.0, 1), "b": (2.0, 2), "c": (3.0, 3)}
    classes = spark.createDataFrame([("w", 0.5, 0.25, 0.1), ("w", 0.2, 0.4, 0.5)], "w string, p_class_slot double, p_class double, p_word_class double")
    assert probability.class_probability(classes, ["w"]).first()["p"] == pytest.approx(0.5 / 0.25 * 0.1 + 0.2 / 0.4 * 0.5)


def test_morphology(spark):
    from glossa.functions import morphology as m

    assert one(spark, m.canonical(F.col("a"), F.col("b")), a="走る", b="はしる") == "走る/はしる"
    assert feats(spark, m.joined_canonical(F.col("f")), "a/a", "", "b/b") == "a/a+b/b"
    assert feats(spark, m.voice_flags(F.col("f")), "voice:passive&causative") == 3 and feats(spark, m.voice_flags(F.col("f")), "x") == 0
    assert feats(spark, m.predicate_key(F.lit("食べる/たべる"), F.lit("verb"), F.col("f")), "voice:passive", "negation") == "食べる/たべる+not:verb:1"
    assert [one(spark, m.case_code(F.col("c")), c=c) for c in ("ga", "を", "zzz")] == [0, 1, None]
    assert one(spark, m.case_name(F.col("c")), c=2) == "ni"
    assert feats(spark, m.or_vectors(m.case_vector(F.col("f")), m.case_vector(F.array(F.lit("wo")))), "ga", "?")[:3] == [1, 1, 0]
    assert sum(feats(spark, m.and_vectors(m.case_vector(F.col("f")), m.case_vector(F.array(F.lit("wo")))), "ga")) == 0
    assert one(spark, m.compound_particle(F.col("c")), c="に対して") == one(spark, m.compound_particle(F.col("c")), c="に対する") == "に対する"
    endings = spark.createDataFrame([("k", "base", "く"), ("k", "imperative", "け")], "kind string, form string, ending string")
    rows = spark.createDataFrame([("動く", "k"), ("本", "n"), ("走る", "k")], "word string, kind string")
    assert {r["word"]: r["inflected"] for r in m.inflected(rows, endings, "imperative").collect()} == {"動く": "動け", "本": None, "走る": None}
    table = spark.createDataFrame([("車", "V1"), ("自動車", "V2")], "key string, value string")
    words = spark.createDataFrame([(1, ["新", "自動", "車"]), (2, ["電", "車"]), (3, ["x"]), (4, [])], "i int, w array<string>")
    assert {r["i"]: r["code"] for r in m.longest_suffix(words, table, "w", "code").collect()} == {1: "V2", 2: "V1", 3: None, 4: None}
    assert one(spark, m.lift(F.col("a"), F.col("b"), F.col("c")), a=0.2, b=0.5, c=0.2) == pytest.approx(2.0)
    assert one(spark, m.margin_probability(F.col("a")), a=0.0) == 0.5
    assert [one(spark, m.binned(F.col("a")), a=x) for x in (0.0, 0.55, 1.0)] == [0, 5, 9]
