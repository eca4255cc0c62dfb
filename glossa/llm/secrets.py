"""Secret scan: token candidates judged by a random forest.

Candidates are of three kinds. Runs: every run of 16 or more token characters of the whole text that has a digit, changes
case twice, or follows an assignment sign. Values: what a word for a secret (`password`, `token`, ...) is assigned, from 8
characters on, whatever they are, where no run is in it. Blocks: private keys from their BEGIN line to their END line, or
the BEGIN line alone where none follows before the next. A run of letters of one case that nothing is assigned to is a
word, not a candidate. Features, all by built-in functions: length, shares of character classes, transitions between the
classes, distinct characters, repeats, coverage by dictionary words, path and file shapes, and the words before and after.
The forest removes false positives (hashes of commits, identifiers, numbers, placeholders, paths). It is trained on
labelled findings that `labelled_findings` writes by rule from a row number, as no table has any, so that training reads
no table and is the same on every run; `scan` also takes a model that was trained before.

Defined cases: null and empty texts have no candidates. Repeated rows repeat their findings. Every run of
a word is judged, each with what stands left of it. A sign = ends a run only where no value follows it: in
`key=value` it is left of the value. Other columns of docs than doc_id and text are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm.common import WORD

RUN = r"[A-Za-z0-9+/_\-]{16,}"
TOKEN = RUN + r"(?:={1,2}(?![\"'`(\[]*[A-Za-z0-9+/_\-=$%@]))?"
ASSIGNED = r"[:=]>?\s*[\"'`]?\z"
SPAN = "struct<token: string, run_no: int, left: string, shape: string, right: string, after: string>"
KEY_BLOCK = r"^[A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?:[\s\S]*?-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----)?"

# Words that tell secrets and other tokens apart.
SECRET_WORDS = "password passwd passphrase pwd secret token apikey key auth bearer credential credentials private access".split()
OTHER_WORDS = "commit sha md5 sha1 sha256 checksum hash uuid guid id version build revision etag digest fingerprint isbn card order invoice ref phone".split()
DICTIONARY = (
    "about account address admin after again agent alpha android apple application archive array asset assets author backup banner base beta "
    "block blue book branch build button cache change changeme chrome class client cloud code commit common component config content control "
    "copy core create data date debug default delete demo design detail develop device document domain download dummy edit element email "
    "engine english error event example export feature file filter final first font footer form format frame front function global google "
    "green group guide handler head header hello help history home house icon image import index info input insert item java jquery label "
    "language large layout level library license light line link linux list local login logo machine main make manager media menu message "
    "method mobile model module month more music name network news next node note number object office online open option order output "
    "package page panel paper parent party pass password path people phone photo picture place placeholder platform play player plugin "
    "point post print private product profile program project public python query read record red release report request resource response "
    "result sample screen script search second section secret server service session setting shop show simple site size small social source "
    "south special sport staff standard start state static station status store story string style summary support system table target task "
    "team test text theme time title token tool total track type update upload user utils value version video view water web week white "
    "widget window word work world year your"
).split()

FEATURES = (
    "run length digits uppers lowers symbols hexes transitions distinct repeated coverage slashes dashes uuid file assigned quoted "
    "known_prefix secret_before other_before secret_inside other_inside word_after"
).split()


def _any_of(words: list[str]) -> str:
    return "(?:" + "|".join(sorted(words, key=len, reverse=True)) + ")"


#: A name that holds a word for a secret, with the sign that assigns to it; and what is assigned.
NAMED = r"(?i)(?:password|passwd|passphrase|secret|token|apikey|credentials?|(?<![a-z])(?:pwd|key|auth|bearer))[\w.\-]{0,12}[\"'`]?\s*[:=]>?[\"'`]?"
VALUE = r"([^\s\"'`,;<>()]{8,})"


def of_words(df: DataFrame) -> DataFrame:
    """df (word, before, after, ...) with a row for each candidate of a word: token, run_no (from 1, 0: a value), left, shape, right.

    left starts at the run before, or else at the words before; shape is the run with what parts it from its neighbours.
    """
    inside = F.regexp_extract("word", NAMED + VALUE, 1)
    follows = F.col("before").rlike(NAMED + r"\z")
    value = F.when(inside != "", inside).when(follows, F.regexp_extract("word", r"^[\"'`(\[]*" + VALUE, 1)).otherwise("")
    cut = df.withColumns({"tokens": F.regexp_extract_all("word", F.lit("(" + TOKEN + ")"), F.lit(1)), "gaps": F.split("word", TOKEN, -1), "value": value})
    gap = lambda k: F.element_at("gaps", k)
    token = lambda i: F.element_at("tokens", i)
    run = lambda i: F.struct(
        token(i).alias("token"),
        i.alias("run_no"),
        F.when(i == 1, F.concat_ws(" ", "before", gap(i))).otherwise(F.concat(token(F.greatest(i - 1, F.lit(1))), gap(i))).alias("left"),
        F.concat(gap(i), token(i), gap(i + 1)).alias("shape"),
        gap(i + 1).alias("right"),
        F.when(i == F.size("tokens"), F.col("after")).otherwise(F.lit("")).alias("after"),
    )
    likely = lambda c: c["token"].rlike("[0-9]") | c["token"].rlike("[a-z][A-Z].*[a-z][A-Z]") | c["left"].rlike(ASSIGNED)
    runs = F.filter(F.transform(F.when(F.size("tokens") > 0, F.sequence(F.lit(1), F.size("tokens"))).otherwise(F.array().cast("array<int>")), run), likely)
    at = F.expr("instr(word, value)")
    assigned = F.struct(
        F.col("value").alias("token"),
        F.lit(0).alias("run_no"),
        F.concat_ws(" ", "before", F.substring("word", F.lit(1), at - 1)).alias("left"),
        F.col("word").alias("shape"),
        F.substring("word", at + F.length("value"), F.length("word")).alias("right"),
        F.col("after").alias("after"),
    )
    whole = (F.col("value") != "") & ~F.col("value").rlike(RUN)
    found = F.concat(runs, F.when(whole, F.array(assigned)).otherwise(F.array().cast(f"array<{SPAN}>")))
    return cut.withColumn("c", F.explode(found)).drop("tokens", "gaps", "value", "word", "before", "after").select("*", "c.*").drop("c")


def features(df: DataFrame) -> DataFrame:
    """df (token, left, shape, right, after, ...), as from runs, with FEATURES."""
    t = F.col("token")
    n = F.greatest(F.length("token"), F.lit(1)).cast("double")
    share = lambda pattern: F.regexp_count(t, F.lit(pattern)) / n
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    left = F.lower("left")
    edge = r"(?:^|[^a-z])"
    return df.withColumns(
        {
            "length": n,
            "digits": share("[0-9]"),
            "uppers": share("[A-Z]"),
            "lowers": share("[a-z]"),
            "symbols": share(r"[+/_\-=]"),
            "hexes": share("[0-9a-fA-F]"),
            "transitions": share("(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])"),
            "distinct": F.size(F.array_distinct(F.split(t, ""))) / n,
            "repeated": F.length(F.regexp_extract(t, r"((.)\2{2,})", 1)) / n,
            "coverage": 1 - F.length(F.regexp_replace(F.lower(t), _any_of([x for x in DICTIONARY if len(x) > 3]), "")) / n,
            "slashes": share("/"),
            "dashes": share(r"[\-_]"),
            "uuid": flag(t.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")),
            "file": flag(F.col("shape").rlike(r"(?i)://|www\.|\.(?:png|jpe?g|gif|svg|html?|css|js|pdf|zip|json|xml|txt|py|java|com|org|net)\b")),
            "assigned": flag(F.col("left").rlike(ASSIGNED)),
            "quoted": flag(F.col("left").rlike(r"[\"']\z") & F.col("right").rlike("^[\"']")),
            "known_prefix": flag(t.rlike("^(?:AKIA|ASIA|ghp_|gho_|sk-|sk_live_|xox[bp]-|AIza|glpat-|eyJ|-----BEGIN )")),
            "run": flag(F.col("run_no") > 0),
            "secret_before": flag(left.rlike(edge + _any_of(SECRET_WORDS) + "(?![a-z])")),
            "other_before": flag(left.rlike(edge + _any_of(OTHER_WORDS) + "(?![a-z])")),
            "secret_inside": flag(F.lower(t).rlike(_any_of(SECRET_WORDS))),
            "other_inside": flag(F.lower(t).rlike("example|sample|test|dummy|placeholder|changeme|xxxx|1234|abcd")),
            "word_after": flag(F.lower(F.coalesce("after", F.lit(""))).rlike("^[a-zà-ÿ]{2,}")),
        }
    )


def labelled_findings(spark: SparkSession, n: int = 14_000) -> DataFrame:
    """(doc_id, text): short texts with one finding each, secrets and look-alikes in turn, written from the row number.

    The label is doc_id modulo 2: 1 for a secret.
    """
    i = F.col("id")
    draw = lambda k, m: F.pmod(F.xxhash64(F.lit(k), i), F.lit(m))
    hexes = lambda k: F.sha2(F.concat(F.lit(k), i.cast("string")).cast("binary"), 512)
    one = lambda k, xs: F.element_at(F.array(*map(F.lit, xs)), (draw(k, len(xs)) + 1).cast("int"))
    plain = lambda k: F.translate(F.base64(F.unhex(hexes(k))), "\r\n", "")
    letters = lambda k: F.translate(F.concat(plain(k + "1"), plain(k + "2")), "+/=0123456789", "")
    upper = F.upper(F.translate(F.substring(plain("a"), 1, 16), "+/=018", "XYZ237"))
    prose = lambda k: F.concat_ws(" ", one(k + "1", ["the", "of", "und", "de", "la", "with", "ein", "que"]), one(k + "2", ["thing", "erste", "mente", "and", "tion", "ver"]))
    names = ["api_key", "token", "secret", "auth_token", "access_key", "password", "client_secret", "private_key", "passphrase"]
    cue = F.concat(one("c1", names), F.lit(" "), one("c2", ["=", ":", "="]))
    key = one("c3", ["password=", "passwd=", "token=", "secret=", "api_key=", "pwd:", "key=", "access_token=", "db_password: ", "token: ", '"secret":'])
    none = one("c4", ["commit", "sha", "md5", "checksum", "uuid", "id", "etag", "version", "build", "hash =", "sha256:", "digest"])
    quote = lambda c: F.when(draw("q", 2) == 0, F.concat(F.lit('"'), c, F.lit('"'))).otherwise(c)
    sep = one("sep", ["_", "-", "/"])
    path = F.concat(one("w1", DICTIONARY), sep, one("w2", DICTIONARY), sep, one("w3", DICTIONARY), sep, draw("num", 9999).cast("string"))
    camel = F.concat(one("w1", DICTIONARY), F.initcap(one("w2", DICTIONARY)), F.initcap(one("w3", DICTIONARY)), F.initcap(one("w4", DICTIONARY)), F.initcap(one("w5", DICTIONARY)))
    length = lambda c, low, high: c.substr(F.lit(1), (draw("len", high - low + 1) + low).cast("int"))
    mark = one("mark", ["!", "#", "$", "%", "&", "*", "@", ""])
    own = F.concat(F.initcap(one("w1", DICTIONARY)), draw("num", 99_999).cast("string"), mark, F.substring(plain("s"), 1, 3))
    block = F.concat(F.lit("-----BEGIN "), one("pem", ["RSA ", "EC ", "OPENSSH ", ""]), F.lit("PRIVATE KEY-----\n"), plain("k1"), F.lit("\n"), plain("k2"), F.when(draw("cut", 3) > 0, F.lit("\n-----END PRIVATE KEY-----")).otherwise(F.lit("")))
    word, before = 1, 2
    kinds = [
        (1, F.concat(F.lit("AKIA"), upper), prose("p")),
        (1, F.concat(key, length(hexes("h"), 16, 64)), prose("p")),
        (1, quote(length(hexes("h"), 32, 64)), cue),
        (1, quote(length(plain("b"), 20, 64)), cue),
        (1, F.concat(key, length(plain("b"), 18, 44)), prose("p")),
        (1, F.concat(one("pre", ["ghp_", "sk-", "xoxb-", "AIza", "glpat-", "sk_live_"]), F.translate(length(plain("b"), 24, 44), "+/=", "xyz")), prose("p")),
        (1, quote(length(letters("l"), 16, 48)), cue),
        (1, F.concat(key, length(letters("l"), 16, 48)), prose("p")),
        (1, F.concat(key, quote(length(plain("b"), 9, 15))), prose("p")),
        (1, quote(length(plain("b"), 9, 15)), cue),
        (1, F.concat(key, own), prose("p")),
        (1, quote(own), cue),
        (1, block, prose("p")),
        (0, length(hexes("h"), 32, 64), none),
        (0, F.concat_ws("-", *[F.substring(hexes("u"), a, k) for a, k in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), one("c5", ["uuid", "id", "request", "session id", "the"])),
        (0, F.translate(length(hexes("d"), 16, 20), "abcdef", "123456"), one("c6", ["card", "number", "phone", "order", "the", "de", "isbn"])),
        (0, path, prose("p")),
        (0, F.concat(F.lit("https://"), one("w1", DICTIONARY), F.lit(".com/"), path, one("ext", [".html", ".png", "", "?page=2"])), prose("p")),
        (0, F.concat(key, one("ph", ["changeme12345678", "xxxxxxxxxxxxxxxx1", "your_password_here_1", "example-password-1", "placeholder_token_123", "test_test_test_1234"])), prose("p")),
        (0, quote(F.concat(F.repeat(one("ch", ["x", "0", "1", "a", "A"]), 20), F.lit("1"))), cue),
        (0, F.concat(one("v1", ["release", "version", "build"]), F.lit("-"), draw("v2", 30).cast("string"), F.lit("-"), one("w1", DICTIONARY), F.lit("-"), draw("v3", 2030).cast("string")), prose("p")),
        (0, camel, prose("p")),
        (0, quote(one("r1", ["required", "optional", "undefined", "********", "changeme", "your_password", "required.", "xxxxxxxx", "<password>", "${PASSWORD}", "example-key", "disabled"])), cue),
        (0, F.concat(key, F.concat(one("w1", DICTIONARY), one("w6", ["_", "-", "", "."]), one("w2", DICTIONARY), one("w7", ["_", "-", ""]), one("w3", DICTIONARY))), prose("p")),
        (0, F.concat(one("w1", DICTIONARY), one("w2", DICTIONARY), one("w3", DICTIONARY), one("w4", DICTIONARY)), cue),
        (0, F.concat_ws("_", one("w1", DICTIONARY), one("w2", DICTIONARY), one("w3", DICTIONARY), one("w4", DICTIONARY)), F.concat(one("w5", DICTIONARY), F.lit(" ="))),
    ]
    one_kind = lambda k: spark.range(k, n, len(kinds), 1).select(
        (i * 2 + kinds[k][0]).alias("doc_id"), F.concat_ws(" ", prose("y"), kinds[k][before], kinds[k][word], prose("z")).alias("text")
    )
    return reduce(DataFrame.unionByName, map(one_kind, range(len(kinds))))


def train(spark: SparkSession, trees: int = 40, depth: int = 10) -> PipelineModel:
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, labelCol="label", featuresCol="features")
    found = features(candidates(labelled_findings(spark))).withColumn("label", (F.col("doc_id") % 2).cast("double"))
    data = assembler.transform(found.coalesce(1)).select("features", "label")
    return PipelineModel([assembler, forest.fit(data)])


def words_of_interest(docs: DataFrame) -> DataFrame:
    """(doc_id, word_no, word, before, after) of every word that may hold a run or a value; before has two words."""
    named = F.lower("text").rlike(_any_of(SECRET_WORDS))
    ws = docs.select("doc_id", named.alias("named"), F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", -1).alias("ws"))
    at = lambda i: F.coalesce(F.try_element_at("ws", i), F.lit(""))
    sign = r"[:=]>?[\"'`]?\z"
    assigned = lambda i: F.col("named") & (F.length(at(i)) >= 8) & (at(i).rlike("[:=]") | ((i > 1) & at(F.greatest(i - 1, F.lit(1))).rlike(sign)))
    likely = lambda i: ((F.length(at(i)) >= 16) & at(i).rlike(RUN)) | assigned(i)
    where = F.filter(F.sequence(F.lit(1), F.size("ws")), likely)
    found = F.transform(
        where,
        lambda i: F.struct(
            i.cast("long").alias("word_no"), at(i).alias("word"),
            F.concat_ws(" ", F.when(i > 2, at(i - 2)), F.when(i > 1, at(i - 1))).alias("before"), at(i + 1).alias("after"),
        ),
    )
    return ws.select("doc_id", F.explode(found).alias("c")).select("doc_id", "c.word_no", "c.word", "c.before", "c.after")


def key_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, word_no, after, token, run_no, left, shape, right) of every private key block."""
    parts = docs.where(F.contains("text", F.lit("-----BEGIN "))).select("doc_id", F.split("text", "-----BEGIN ", -1).alias("parts"))
    counted = parts.withColumn("sizes", F.transform("parts", lambda p: F.regexp_count(p, F.lit(WORD))))
    each = counted.select("doc_id", "sizes", F.posexplode("parts").alias("no", "part")).where("no > 0")
    found = each.withColumn("body", F.regexp_extract("part", "(" + KEY_BLOCK + ")", 1)).where("body <> ''")
    ahead = F.aggregate(F.slice("sizes", F.lit(1), F.col("no")), F.lit(0), lambda a, x: a + x)
    token = F.concat(F.lit("-----BEGIN "), F.col("body"))
    none = F.lit("")
    return found.select(
        "doc_id", (ahead + F.col("no")).cast("long").alias("word_no"), none.alias("after"), token.alias("token"), F.lit(1).alias("run_no"),
        none.alias("left"), token.alias("shape"), none.alias("right"),
    )


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, word_no, after, token, run_no, left, shape, right) of every candidate; word_no is that of its first word.

    Runs inside a key block are candidates of their own.
    """
    own = docs.select("doc_id", "text")
    cols = ["doc_id", "word_no", "after", "token", "run_no", "left", "shape", "right"]
    return of_words(words_of_interest(own)).select(cols).unionByName(key_blocks(own))


def scan(docs: DataFrame, model: PipelineModel | None = None) -> DataFrame:
    """doc_id, word_no (from 1), kind, token_sha256, length, score, is_secret for every candidate; tokens stay hidden."""
    model = model or train(docs.sparkSession)
    scored = model.transform(features(candidates(docs)))
    p = vector_to_array("probability")[1]
    kind = F.when(F.col("token").startswith("-----BEGIN "), "key_block").when(F.col("known_prefix") == 1, "provider_key").when(F.col("assigned") == 1, "assignment").otherwise("token")
    return scored.select(
        "doc_id",
        "word_no",
        kind.alias("kind"),
        F.sha2(F.col("token").cast("binary"), 256).alias("token_sha256"),
        F.length("token").cast("long").alias("length"),
        F.round(p, 6).alias("score"),
        (p >= 0.5).alias("is_secret"),
    )
