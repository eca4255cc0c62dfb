import itertools
import random
import time

import numpy as np
import pytest

from glossa.operators import anaphora, chart, coordination, crf, frames, lattice, rules
from glossa.operators.rules import Pattern, Rule, Unit


def units(*words):
    return [Unit({"surface": w, "pos": "N" if w[0].isupper() else "x"}) for w in words]


def features(us):
    return [u.features for u in us]


def test_rule_context_and_longest():
    p = rules.parse_pattern
    rule = Rule(("hit",), p("[pos=N]*"), p("[surface=a]"), p("[surface=z]"))
    assert features(rules.apply([rule], units("a", "B", "C", "z"))) == [[], ["hit"], ["hit"], []]
    assert features(rules.apply([rule], units("b", "B", "z"))) == [[], [], []]
    start = Rule(("first",), None, None, None)
    assert features(rules.apply([start], units("a", "b"))) == [["first"], []]


@pytest.mark.parametrize(("by", "leave", "want"), [("unit", "none", [["1", "2"], ["1", "2"]]), ("unit", "normal", [["1"], ["1"]]), ("rule", "normal", [["1", "2"], []])])
def test_rule_loops(by, leave, want):
    own = [Rule(("1",), rules.parse_pattern("[pos=N]")), Rule(("2",), rules.parse_pattern("[pos=N]"))]
    assert features(rules.apply(own, units("A", "B"), by=by, leave=leave)) == want


def test_rule_jump_actions_and_functions():
    span = Rule(("in", "0|first"), rules.parse_pattern("[pos=N]*"))
    us = rules.apply([span], units("A", "B", "c"), leave="jump")
    assert features(us) == [["in", "first"], ["in"], []]
    us = rules.apply([Rule(("&spread:1:mark", "&lemma:q", "&copy:surface:form"), rules.parse_pattern("[&is:A]"))], units("A", "b"), functions={"is": lambda u, i, a: u[i].attributes["surface"] == a})
    assert us[0].attributes["lemma"] == "q" and us[0].features == ["form:A"] and us[1].features == ["mark"]


def test_pattern_of_parts_and_optional():
    phrase = Unit({}, parts=units("A", "b"))
    assert Pattern(parts=rules.parse_pattern("[pos=N][surface=b]?")).fits([phrase], 0, {})
    assert not Pattern(parts=rules.parse_pattern("[pos=N]")).fits([phrase], 0, {})


def test_homographs():
    alternatives = [Unit({"surface": "x", "lemma": "a", "pos": "V"}), Unit({"surface": "x", "lemma": "b", "pos": "N"})]
    assert rules.choose_homograph(alternatives, [rules.parse_pattern("[pos=N][pos=V]")]) == (1, ["ALT-x:a", "ambiguous"])
    assert rules.choose_homograph(alternatives, [rules.parse_pattern("[pos=N][pos=A]")])[0] == 0


def test_lattice_finds_the_cheapest_path():
    words = [lattice.Word(w, w, "N", 1, 1) for w in ("外国", "国人", "外国人", "人", "参政", "参政権", "政権")]
    grammar = lattice.Grammar({"N": 10, "Unknown": 30}, {(1, 1): 5, (0, 1): 1, (1, 0): 1})
    trie = lattice.Trie(words)
    nodes = lattice.analyse("外国人参政権", trie, grammar)
    path = lattice.best_path(nodes)
    assert [n.word.surface for n in path] == ["外国人", "参政権"]
    paths = list(lattice.all_paths(nodes))
    assert [n.word.surface for n in paths[0]] == ["外国人", "参政権"]


def test_lattice_matches_brute_force():
    rng = random.Random(3)
    words = [lattice.Word("".join(rng.choice("abc") for _ in range(rng.randint(1, 3))), "", "N", rng.randint(1, 3), rng.randint(1, 3), rng.choice([0.5, 1.0, 2.0])) for _ in range(20)]
    grammar = lattice.Grammar({"N": 7.0, "Unknown": 9.0}, {(a, b): float(rng.randint(1, 5)) for a in range(4) for b in range(4)})
    trie = lattice.Trie(words)
    for _ in range(20):
        text = "".join(rng.choice("abc") for _ in range(rng.randint(1, 6)))

        def cost(at, right, text=text):
            if at == len(text):
                return grammar.join(right, 0)
            found = [(e, w) for e, w, _ in trie.walk([[(c, 0.0)] for c in text], at)]
            found += [(at + len(w.surface), w) for w in lattice.unknown_words(text, at) if all(w.surface != f.surface for _, f in found)]
            return min(grammar.join(right, w.left) + grammar.cost(w) + cost(e, w.right) for e, w in found)

        assert lattice.analyse(text, trie, grammar)[-1].score == pytest.approx(cost(0, 0))


def test_unknown_words_and_alternatives():
    kinds = lambda t: [w.surface for w in lattice.unknown_words(t, 0)]
    assert kinds("カーテン") == ["カーテン"] and kinds("abc.def 1") == ["abc.def"] and kinds("漢字") == ["漢"]
    assert kinds("どきどき")[1] == "どきどき"
    trie = lattice.Trie([lattice.Word("すごい", "すごい", "A")])
    path = lattice.best_path(lattice.analyse("すごーい", trie, lattice.Grammar({"Unknown": 100}), True))
    assert [n.word.lemma for n in path] == ["すごい"]
    numbers = lattice.best_path(lattice.analyse("12", lattice.Trie([lattice.Word("1", "1", "Number"), lattice.Word("2", "2", "Number")]), lattice.Grammar({"Number": 1, "Unknown": 99})))
    assert [n.word.surface for n in lattice.join_numbers(numbers)] == ["12"]


def test_inflection_and_compile():
    endings = {"k": {"base": "く", "imperative": "け", "te": "いて"}}
    assert lattice.inflect("動く", "k", "imperative", endings) == "動け"
    assert lattice.inflect("動け", "k", "base", endings, "imperative") == "動く"
    assert lattice.inflect("動く", "k", "none", endings) is None
    assert {w.surface for w in lattice.compile_lexicon([{"surface": "動く", "pos": "V", "kind": "k"}, {"surface": "本", "pos": "N"}], endings)} == {"動く", "動け", "動いて", "本"}
    assert lattice.compile_connections([([1, 2], [3], 9.0), ([1], [3], 4.0)]) == {(1, 3): 4.0, (2, 3): 9.0}


def random_sentence(rng, n):
    own = [
        chart.Phrase(
            rng.choice([1, 1, 2, -1]), rng.choice([frozenset(), frozenset(rng.sample(range(n), n // 2)), None]), rng.random() < 0.2, rng.random() < 0.3, rng.random() < 0.6, 1.0,
            rng.choice([None, "s", "o"]), frozenset(("s", "o")),
        )
        for _ in range(n)
    ]
    types = tuple(tuple("D" if j > i and (rng.random() < 0.7 or j == n - 1) else None for j in range(n)) for i in range(n))
    return chart.Sentence(tuple(own), types)


def test_chart_equals_exhaustive_search():
    rng = random.Random(5)
    for _ in range(60):
        s = random_sentence(rng, rng.randint(1, 7))
        assert chart.parse(s, beam=10_000)[0][0] == pytest.approx(chart.exhaustive(s)[0])


def test_trees_are_projective_and_rooted():
    rng = random.Random(6)
    for _ in range(20):
        _, heads = chart.parse(random_sentence(rng, 9), beam=5)[0]
        assert heads[-1] == -1 and all(i < h < 9 for i, h in enumerate(heads[:-1]))
        assert not any(i < j < heads[i] < heads[j] for i, j in itertools.combinations(range(8), 2))


def test_chart_time_limit_and_drawing():
    s = random_sentence(random.Random(1), 6)
    assert chart.parse(s, seconds=1e-9)[0] == chart.fallback(s)
    text = chart.draw(["a", "b", "c"], [2, 2, -1])
    assert len(text.split("\n")) == 3 and "┐" in text and "└" in text
    assert chart.to_sexp(["a", "b c", "d"], [2, 2, -1]) == '(d (a) ("b c"))'


def test_sentences_that_fall_back_are_marked(spark):
    rows = spark.createDataFrame([(1, [None] * 6, [False] * 6, [True] * 6)], "id int, cases array<string>, commas array<boolean>, predicates array<boolean>")
    late, whole = (chart.parse_sentences(rows, ["id"], seconds=x).first() for x in (1e-9, 180.0))
    assert late["fallback"] == "time" and late["heads"] == [1, 2, 3, 4, 5, -1] and whole["fallback"] is None


def test_plain_search_is_the_chart_search():
    rng = random.Random(8)
    kinds = {None: chart.BARE, "subject": chart.SUBJECT, "object": chart.OBJECT, "topic": chart.TOPIC, "dative": chart.OTHER}
    for _ in range(150):
        n, often, comma = rng.randint(1, 14), rng.choice([0.1, 0.4, 0.8, 1.0]), rng.choice([0.0, 0.2, 0.6])
        cases, commas, predicates = [rng.choice([*kinds]) for _ in range(n)], [rng.random() < comma for _ in range(n)], [rng.random() < often for _ in range(n)]
        beam = rng.choice([1, 2, 8, 8])
        plain = chart.plain_sentence(cases, commas, predicates)
        best, why = chart.search(plain, beam)
        codes, barriers = [kinds[c] for c in cases], [a and b for a, b in zip(commas, predicates, strict=True)]
        assert chart.search_plain(codes, predicates, barriers, beam) == (best[0][0], list(best[0][1]), why)
        late = chart.search_plain(codes, predicates, barriers, beam, 1e-9)
        assert n < 2 or late == (chart.fallback(plain)[0], list(chart.fallback(plain)[1]), "time")


def test_long_sentences_are_parsed_in_time(spark):
    rng = random.Random(9)
    make = lambda i, n, often: (i, [rng.choice([None, "subject", "object"]) for _ in range(n)], [False] * n, [rng.random() < often for _ in range(n)])
    rows = spark.createDataFrame([make(1, 120, 0.5), make(2, 5000, 0.0005)], "id int, cases array<string>, commas array<boolean>, predicates array<boolean>")
    found = {r["id"]: r for r in chart.parse_sentences(rows, ["id"], seconds=20.0).collect()}
    assert [found[i]["fallback"] for i in (1, 2)] == [None, None] and len(found[2]["heads"]) == 5000


def test_coordination_scope_and_relations():
    item = coordination.Item
    items = [item("old"), item("cats"), item("young"), item("cats"), item("ran", True)]
    s = coordination.scope(items, 1)
    assert (s.key, s.end) == (1, 3) and s.path[-1] == (1, 3) and s.status == "strong"
    assert coordination.scope([item("a"), item("ran", True)], 0) is None
    make = lambda a, k, e: coordination.Scope(a, k, e, 1.0, (), "found")
    assert coordination.relation(make(0, 1, 2), make(4, 5, 6)) == "apart"
    assert coordination.relation(make(0, 0, 1), make(0, 1, 3)) == "inner"
    assert coordination.relation(make(0, 2, 6), make(3, 4, 5)) == "outer"
    assert coordination.relation(make(0, 1, 2), make(2, 2, 3)) == "same"
    assert coordination.relation(make(0, 1, 3), make(1, 4, 6)) == "bad"
    assert all(coordination.relation(a, b) != "bad" for a, b in itertools.combinations(coordination.consistent(items, [0, 1, 2]), 2))


def random_items(rng, n, rich):
    def one():
        more = {"kind": rng.choice(["", "quantity", "person", "place"]), "unit": rng.choice("xy"), "particles": frozenset(rng.sample("pqr", rng.randint(0, 2))), "topic": rng.random() < 0.3} if rich else {}
        return coordination.Item("".join(rng.choice("abc") for _ in range(rng.randint(1, 7))), rng.random() < 0.3, level=int(rng.random() < 0.2) - 1, **more)

    return [one() for _ in range(n)]


@pytest.mark.parametrize("few", [2, 64])
def test_scopes_by_grid_are_those_of_each_end(monkeypatch, few):
    monkeypatch.setattr(coordination, "FEW", few)
    rng = random.Random(few)
    for k in range(40):
        items = random_items(rng, rng.randint(2, 40), k % 3 == 0)
        key, n = rng.randrange(len(items)), rng.randint(1, len(items))
        one = coordination.align(items, key, range(key + 1, n))
        assert coordination.Grid.of(items).best(key, n) == (one and (one.score, one.start, one.end, pytest.approx(one.score * (one.end - one.start + 1) ** 0.5)))
        assert coordination.scope(items, key) == coordination.align(items, key, range(key + 1, len(items)))
        keys = [i for i, x in enumerate(items) if not x.level]
        bare, full = coordination.consistent(items, keys, paths=False), coordination.consistent(items, keys)
        assert [(s.start, s.key, s.end, s.score, s.status) for s in bare] == [(s.start, s.key, s.end, s.score, s.status) for s in full] and all(s.path for s in full)


def test_scopes_of_long_sentences_end():
    items = random_items(random.Random(3), 500, False)
    began = time.monotonic()
    found = coordination.consistent(items, [i for i, x in enumerate(items[:-1]) if not x.level], paths=False)
    assert found and time.monotonic() - began < 60
    assert not any(coordination.relation(a, b) == "bad" for a, b in itertools.combinations(found, 2))


@pytest.mark.parametrize(("few", "short", "run"), [(2, 12, 12), (2, 12, 1), (40, 128, 12)])
def test_scopes_of_many_sentences_are_those_of_each(monkeypatch, few, short, run):
    monkeypatch.setattr(coordination, "FEW", few)
    monkeypatch.setattr(coordination, "RUN", run)
    monkeypatch.setattr(coordination, "SHORT", short)
    rng = random.Random(few)
    sentences = [[x for x in random_items(rng, rng.randint(1, 40), False) for _ in range(rng.randint(1, 5) if k % 2 else 1)][:60] for k in range(40)]
    keys = [[i for i, x in enumerate(items[:-1]) if not x.level] for items in sentences]
    found = coordination.consistent_many(coordination.Marks.of([x for items in sentences for x in items]), [len(x) for x in sentences], keys)
    for k, items in enumerate(sentences):
        each = {key: coordination.align(items, key, range(key + 1, len(items))) for key in keys[k]}
        grid = coordination.Grid.of(items).many(keys[k], len(items))
        assert {key: (s.score, s.start, s.end) for key, s in each.items() if s} == {key: best[:3] for key, best in grid.items()}
        assert [s for i, s in found if i == k] == coordination.consistent(items, keys[k], paths=False)


def test_scopes_of_runs_of_equal_words_end():
    words = ["Nd", "of,", "Des", "The", "la", "ra,", "Nd", "The"]
    items = [coordination.Item(w.strip(",").lower(), w == "The", level=int("," in w) - 1) for w in words for _ in range(300)]
    began = time.monotonic()
    found = coordination.consistent(items, [i for i, x in enumerate(items[:-1]) if not x.level], paths=False)
    assert found and time.monotonic() - began < 25
    assert not any(coordination.relation(a, b) == "bad" for a, b in itertools.combinations(found, 2))


def test_crf_marginals_and_paths_match_enumeration():
    rng = np.random.default_rng(2)
    unary, pair = rng.normal(size=(4, 3)), rng.normal(size=(3, 3))
    score = lambda y: sum(unary[t, y[t]] for t in range(4)) + sum(pair[a, b] for a, b in zip(y, y[1:], strict=False))
    every = sorted(itertools.product(range(3), repeat=4), key=score, reverse=True)
    z, single, _ = crf.marginals(unary, pair)
    assert z == pytest.approx(np.log(sum(np.exp(score(y)) for y in every)))
    assert single[1, 2] == pytest.approx(sum(np.exp(score(y) - z) for y in every if y[1] == 2))
    assert tuple(crf.viterbi(unary, pair)) == every[0]
    assert [tuple(y) for _, y in crf.n_best(unary, pair, 5)] == every[:5]


DATA = [([[w] for w in s.split()], ["N" if w[0].isupper() else "O" for w in s.split()]) for s in ("a Cat sat", "the Dog in Rome", "we Saw it", "Cat and Dog")]


@pytest.mark.parametrize("method", ["l2", "l1", "mira"])
def test_crf_learns(method):
    f = crf.Features.build(["U0:%x[0,0]", "U1:%x[-1,0]", "B"], DATA)
    w = crf.train(f, DATA, method, 10.0, 40)
    for rows, tags in DATA:
        assert [f.labels[i] for i in crf.viterbi(*crf.potentials(f, w, f.encode(rows)))] == tags


def test_crf_gradient():
    f = crf.Features.build(["U0:%x[0,0]", "B"], DATA)
    w = np.random.default_rng(0).normal(size=f.size)
    x, y = f.encode(DATA[1][0]), [f.labels.index(t) for t in DATA[1][1]]
    value, g = crf.gradient(f, w, x, y)
    for i in range(0, f.size, 3):
        d = np.zeros(f.size)
        d[i] = 1e-6
        assert (crf.gradient(f, w + d, x, y)[0] - value) / 1e-6 == pytest.approx(g[i], abs=1e-4)


def test_entity_labels():
    assert len(crf.ENTITY_LABELS) == 33
    p = np.full((3, 33), 0.01)
    at = crf.ENTITY_LABELS.index
    p[0, at("PERSON:head")], p[1, at("LOCATION:middle")], p[1, at("PERSON:tail")], p[2, at("OTHER")] = 0.9, 0.8, 0.5, 0.9
    assert crf.decode_entities(p) == ["PERSON:head", "PERSON:tail", "OTHER"]
    assert crf.decode_entities(p, [True, False, False])[0] == "OTHER"


def brute_assignment(elements, frame):
    best = None
    for chosen in itertools.product(range(-1, len(frame.slots)), repeat=len(elements)):
        used = [c for c in chosen if c >= 0]
        if len(set(used)) < len(used) or any(frame.slots[c].case not in e.cases for c, e in zip(chosen, elements, strict=True) if c >= 0):
            continue
        score = np.log(frame.probability) + sum(frames.slot_log(e, frame.slots[c]) if c >= 0 else frames.UNASSIGNED for c, e in zip(chosen, elements, strict=True))
        score += sum(np.log(1 - s.filled) + (frames.UNMATCHED_ADJACENT if s.obligatory and s.adjacent else 0) for i, s in enumerate(frame.slots) if i not in used)
        best = score if best is None else max(best, score)
    return best


def test_frame_assignment_matches_enumeration():
    rng = random.Random(4)
    for _ in range(30):
        slots = tuple(frames.Slot(c, {w: rng.random() for w in "xyz" if rng.random() < 0.7}, rng.uniform(0.1, 0.9), rng.random() < 0.3, rng.random() < 0.3) for c in ("ga", "wo", "ni"))
        elements = tuple(frames.Element(rng.choice("xyz"), tuple(rng.sample(("ga", "wo", "ni"), 2))) for _ in range(3))
        frame = frames.Frame("f", 0.3, slots)
        assert frames.assign(elements, frame)[0] == pytest.approx(brute_assignment(elements, frame))
    assert [f for _, f, _ in frames.best_frames((frames.Element("x", ("ga",)),), [frames.Frame("a", 0.1, ()), frames.Frame("b", 0.9, ())], 1)] == ["b"]


def test_coreference_and_zero_anaphora():
    ph = anaphora.Phrase
    assert anaphora.same_entity(ph("Tan", 0), ph("Tanaka", 0, kind="PERSON"))
    assert anaphora.same_entity(ph("東京", 0), ph("東京都", 0, kind="LOCATION"))
    assert anaphora.same_entity(ph("bigcar", 0), ph("bigauto", 0), frozenset({("car", "auto")}))
    assert not anaphora.same_entity(ph("a", 0, kind="PERSON"), ph("a", 0, kind="LOCATION"))
    state = anaphora.Article()
    first = state.analyse([ph("Tanaka", 0, "topic", "PERSON", head=2), ph("book", 0, "object", head=2), ph("buy", 0, predicate=True, slots=("subject", "object"))])
    assert {(s, state.entities[e].name, overt) for _, s, e, overt in first} == {("subject", "Tanaka", True), ("object", "book", True)}
    second = state.analyse([ph("read", 1, predicate=True, slots=("subject",))])
    assert [(s, state.entities[e].name, overt) for _, s, e, overt in second] == [("subject", "Tanaka", False)]
    assert state.refer(ph("Tanaka", 30)) != state.known[0][1]  # too far back


def test_decision_list_and_tournament(spark):
    own = [anaphora.Decision("x", 3, "yes", 0.9), anaphora.Decision("y", 1, "maybe", 0.6, False)]
    assert anaphora.decide(own, {"x": 4}) == ("yes", 0.9) and anaphora.decide(own, {"x": 1, "y": 0}) == ("maybe", 0.6) and anaphora.decide(own, {}) == ("no", 0.5)
    rows = spark.createDataFrame([(4, 9), (1, 0), (1, 9)], "x int, y int")
    assert [r[0] for r in rows.select(anaphora.decide_column(own)).collect()] == ["yes", "maybe", "no"]
    assert anaphora.tournament([3, 5, 4], lambda a, b: a > b) == 5
    assert anaphora.author_reader(["I am", "you are", "x"]) == pytest.approx((1 / 3, 1 / 3))


def test_tree_conversions():
    from glossa.operators import trees

    heads, spans = [2, 2, -1], [(0, 1), (2, 2), (3, 5)]
    finer = trees.finer_heads(heads, spans)
    assert finer == [1, 3, 3, 4, 5, -1] and trees.coarser_heads(finer, spans) == heads
    assert trees.expand_coordination([1, 2, 3, -1], ["P", "P", "D", "D"]) == [3, 3, 3, -1]
    assert trees.depths([2, 2, 3, -1]) == [2, 2, 1, 0]
    merged, spans = trees.merge_nodes([1, 2, 3, -1], [False, True, False, False])
    assert merged == [1, 2, -1] and spans == [(0, 0), (1, 2), (3, 3)] and trees.finer_heads(merged, spans) == [1, 2, 3, -1]


def test_frames_of_a_tree():
    from glossa.operators import trees

    eat = (frames.Frame("eat1", 0.7, (frames.Slot("ga", {"cat": 1.0}, 0.8), frames.Slot("wo", {"fish": 1.0}, 0.8))), frames.Frame("eat2", 0.3, (frames.Slot("de", {"*": 1.0}, 0.5),)))
    units = [trees.TreeUnit("cat", ("ga",)), trees.TreeUnit("fish", ("wo", "ga")), trees.TreeUnit("eat", frames=eat)]
    score, found = trees.analyse_tree(units, [2, 2, -1])
    assert found == {2: ("eat1", {"ga": "cat", "wo": "fish"})} and score < 0
    clause = [trees.TreeUnit("cat", ("ga",)), trees.TreeUnit("eat", frames=eat), trees.TreeUnit("fish")]
    assert trees.analyse_tree(clause, [1, 2, -1], relative=lambda u: ("ga", "wo"))[1] == {1: ("eat1", {"ga": "cat", "wo": "fish"})}


def test_rule_predicates():
    from glossa.operators.predicates import FUNCTIONS, compare, with_tables
    from glossa.operators.rules import Unit

    def holds(surface, name, argument="", features=(), attributes=None, parts=()):
        own = Unit({"surface": surface} | (attributes or {}), list(features), [Unit({"surface": p}) for p in parts])
        return FUNCTIONS[name]([Unit({"surface": "<"}), own, Unit({"surface": ">", "lemma": "x"})], 1, argument)

    yes = [
        ("ひらがな", "hiragana"), ("カタカナー", "katakana"), ("漢字々", "kanji"), ("漢字とかな", "kana_or_kanji"), ("123", "digit"), ("abc", "letter"), ("?!", "symbol"), ("漢1", "mixed"),
        ("a1", "has_letter_or_digit"), ("漢か", "ends_in_hiragana"), ("a", "single"), ("a!", "has_symbol"), ("aか", "has_kana"),
    ]
    assert all(holds(*x) for x in yes)
    assert not any(holds(s, n) for s, n in [("かナ", "hiragana"), ("", "kanji"), ("ab", "single"), ("ab", "mixed"), ("か漢", "ends_in_hiragana"), ("ab", "has_symbol")])
    assert holds("abcd", "length", "4") and holds("abcd", "length", "lt:5") and not holds("abcd", "length", "gt:4") and holds("a12", "digits", "eq:2") and holds("12.5", "number", "le:12.5")
    assert holds("walked", "ends_with", "ed") and holds("x", "tail", "b+c", parts="abc") and not holds("x", "tail", "a+c", parts="abc") and holds("x", "parts", "3", parts="abc")
    assert holds("x", "category", "food", ["category:plant;food"]) and holds("x", "semantic", "time", attributes={"sem": "time;event"}) and holds("x", "time", attributes={"sem": "time"})
    assert holds("x", "case", "wo", ["cases:ga;wo"]) and holds("x", "level", "B", ["level:C"]) and not holds("x", "level", "B", ["level:A"]) and holds("x", "level", "C")
    assert holds("x", "voice", "passive", ["voice:causative&passive"]) and holds("x", "feature", "score:ge:3", ["score:3.5"]) and holds("x", "text_at", "-1:<") and not holds("x", "at", "1:f")
    units = [Unit({"head": "1"}, ["topic"]), Unit({"head": "3"}, ["verb"]), Unit({"head": "1"}, ["topic"]), Unit({"head": "-1"}, ["end"])]
    f = FUNCTIONS
    assert f["governor_has"](units, 0, "verb") and f["dependent_has"](units, 1, "topic") and f["dependents_all_have"](units, 1, "topic") and f["no_dependent"](units, 0, "") and not f["no_dependent"](units, 3, "")
    assert f["within"](units, 0, "1") and not f["within"](units, 1, "1") and f["first"](units, 0, "") and f["last"](units, 3, "") and not f["within"](units, 3, "9")
    same = [Unit({"lemma": "go", "pos": "V"}), Unit({"lemma": "go", "pos": "N"})]
    assert f["same_lemma"](same, 0, "1") and not f["same_pos"](same, 0, "1") and not f["same_surface"](same, 0, "1") and not f["same_lemma"](same, 0, "5")
    more = with_tables({("go", "walk"): 0.7}, {("dog", "bark"): 2}, ["fast"], ["go"])
    pair = [Unit({"lemma": "walk"}), Unit({"lemma": "go"}), Unit({"lemma": "dog"}), Unit({"lemma": "bark"})]
    assert more["similar"](pair, 0, "1:0.5") and not more["similar"](pair, 0, "1:0.8") and more["mi_rank"](pair, 2, "1:3") and not more["mi_rank"](pair, 3, "-1:3")
    assert more["option"](pair, 0, "fast") and more["known"](pair, 1, "") and not more["known"](pair, 0, "")
    assert compare("9", "lt", "10") and not compare("a9", "lt", "a10")


def test_rule_actions_and_sets():
    from glossa.operators.rules import Pattern, Rule, RuleSet, Tables, act, dispatch

    units = [Unit({"surface": s, "lemma": s}, ["content"]) for s in ("a", "ni-tsuite", "c")]
    tables = Tables(frozenset(["c"]), {"ni-tsuite": ("ni", 17)})
    for at, action in [
        (0, "&case:ga"), (0, "&case:wo"), (0, "&case:ga"), (0, "&uncase:ga"), (1, "&cases:ni;de"), (2, "&case:x"), (2, "&cases:"), (1, "&memo:first"), (2, "&memo:second"), (1, "&particle:"), (1, "&particle_id:"),
        (0, "&remember:lemma"), (2, "&recall:lemma:seen"), (1, "&function:"), (2, "&known:listed"), (0, "&known:listed"), (2, "&pos:Noun"), (2, "&spread:-2:from-c"),
    ]:
        act(units, at, 0, action, tables)
    assert units[0].value("cases") == "wo" and units[1].value("cases") == "ni;de" and units[2].value("cases") is None and units[0].value("memo") == "first second"
    assert units[1].value("particle") == "ni" and units[1].value("particle_id") == "17" and units[2].value("seen") == "a" and units[1].has("function") and not units[1].has("content")
    assert units[2].has("listed") and not units[0].has("listed") and units[2].attributes["pos"] == "Noun" and units[0].has("from-c")
    mark = lambda f, on: Rule((f,), (Pattern(features=((on,),)),))
    phrase = [Unit({}, [], [Unit({}, ["m"]), Unit({}, [])])]
    sets = [RuleSet("second", (mark("c", "b"),)), RuleSet("first", (mark("b", "m"),), level="parts"), RuleSet("first", (Rule(("p",), (Pattern(parts=(Pattern(features=(("b",),)), Pattern())),)),))]
    dispatch(sets, "first", phrase)
    assert [u.features for u in phrase[0].parts] == [["m", "b"], []] and phrase[0].features == ["p"]
    dispatch(sets, "second", phrase)
    assert phrase[0].features == ["p"]


def test_rule_loaders():
    from glossa.operators.rules import apply
    from glossa.sources import sexpr

    s = sexpr.morpheme_rules('("" "[pos=N]" ? ("noun"))', by="rule")
    assert [u.features for u in apply(s.rules, [Unit({"pos": "N"}), Unit({"pos": "V"})])] == [["noun"], []] and s.by == "rule"
    p = sexpr.phrase_rules('(() ("[pos=N] [pos=P]") ? ("np")) (? ("<np>") ? ("first"))')
    phrases = [Unit({}, [], [Unit({"pos": x}) for x in xs]) for xs in ("NP", "V", "NP")]
    assert [u.features for u in apply(p.rules, phrases)] == [["np", "first"], [], ["np"]]
    h = sexpr.homograph_rules('("[pos=N]" "[pos=V]")')
    assert rules.choose_homograph([Unit({"pos": "V"}), Unit({"pos": "N"})], h)[0] == 1
    d = sexpr.dependency_rules('("[case=ga]" (("[pos=V]" D) ("[pos=N]" P)) "[level=C]" -1) ("[x=y]" (("[pos=V]" D)) ? 1)')
    assert d[0] == {"dependent": "[case=ga]", "governors": [("[pos=V]", "D"), ("[pos=N]", "P")], "barrier": "[level=C]", "preference": -1} and d[1]["barrier"] is None
    assert sexpr.correlation_rules('("[a=b]" "[c=d]") ("[a=b]" "[c=d]" "[e=f]")')[1]["governor"] == "[e=f]"


def test_runs_as_unknown_words_gives_them(spark):
    from pyspark.sql import functions as F

    from glossa.operators import lattice

    texts = ["abc.d 12カタカナー、ひらが漢字 x1y.", "é?ñ..", "", "a\nb", "ー々〆12"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", lattice.unknown_runs(F.col("t")).alias("r")).orderBy("i").collect()
    for r, t in zip(got, texts, strict=True):
        want, at = [], 0
        while at < len(t):
            want.append(next(iter(lattice.unknown_words(t, at))).surface)
            at += len(want[-1])
        assert r["r"] == want
    words = ["abab", "aaaa", "abcabc", "ab", "aa", "abcdabcd", "abcdeabcde", "aba"]
    found = spark.createDataFrame([(w,) for w in words], "w string").where(lattice.is_repetition(F.col("w"))).collect()
    assert sorted(r[0] for r in found) == ["abab", "abcabc", "abcdabcd"]


def test_synonym_pairs(spark):
    from glossa.operators.anaphora import strip_common
    from glossa.operators.discourse import synonym_pairs

    words, syn = ["walking", "walked", "unwalked", "king", "ked", "goals", "goald", "sings", "edsed"], [("ing", "ed"), ("s", "d")]
    got = {tuple(r) for r in synonym_pairs(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame(syn, "x string, y string")).collect()}
    assert got == {(a, b) for a in words for b in words if strip_common(a, b) in syn}


def test_crf_bigram_templates_with_macros(spark):
    """Labels that only the pair of a word and the label before tells, by a template `B1:%x[0,0]`, against all label sequences."""
    data = [([["a", "1"], ["x", "1"], ["b", "1"], ["x", "1"]], ["P", "P", "Q", "Q"]), ([["b", "2"], ["x", "2"], ["a", "2"], ["x", "2"]], ["Q", "Q", "P", "P"])]
    f = crf.Features.build(["U0:%x[0,0]", "U1:%x[0,1]", "B", "B1:%x[0,0]"], data)
    assert set(f.pairs) == {"B", "B1:a", "B1:b", "B1:x"} and f.size == (3 + 2) * 2 + 4 * 4
    w = crf.train(f, data, "l2", 10.0, 60)
    for rows, tags in data:
        assert [f.labels[i] for i in crf.viterbi(*crf.potentials(f, w, f.encode(rows)))] == tags
    rng = np.random.default_rng(0)
    w = rng.normal(size=f.size)
    x = f.encode(data[0][0])
    unary, pair = crf.potentials(f, w, x)
    score = lambda ys: sum(unary[t, y] for t, y in enumerate(ys)) + sum(pair[t, ys[t - 1], ys[t]] for t in range(1, len(ys)))
    every = sorted(itertools.product(range(2), repeat=4), key=lambda ys: -score(ys))
    z, single, joint = crf.marginals(unary, pair)
    total = sum(np.exp(score(ys)) for ys in every)
    assert z == pytest.approx(np.log(total)) and tuple(crf.viterbi(unary, pair)) == every[0] and [tuple(y) for _, y in crf.n_best(unary, pair, 4)] == every[:4]
    assert single[2, 1] == pytest.approx(sum(np.exp(score(ys)) for ys in every if ys[2] == 1) / total)
    assert joint[2, 0, 1] == pytest.approx(sum(np.exp(score(ys)) for ys in every if ys[1:3] == (0, 1)) / total)
    y = [0, 1, 1, 0]
    value, g = crf.gradient(f, w, x, y)
    for i in range(f.size):
        d = np.zeros(f.size)
        d[i] = 1e-6
        assert (crf.gradient(f, w + d, x, y)[0] - value) / 1e-6 == pytest.approx(g[i], abs=1e-4)
    tagged = crf.tag(spark.createDataFrame([(1, data[0][0]), (2, [])], "id long, tokens array<array<string>>"), ["id"], f, crf.train(f, data, "l2", 10.0, 60))
    assert {r["id"]: r["tags"] for r in tagged.collect()} == {1: ["P", "P", "Q", "Q"], 2: []}


def test_svm_entities(spark):
    """Names are capitalised words after a title; machines by window features, decoded to legal labels."""
    from glossa.operators import svm

    rng = random.Random(3)
    rows = []
    for s in range(60):
        words = []
        for _ in range(4):
            words += [("mr", "OTHER"), (rng.choice(["Ann", "Bob", "Cid"]), "PERSON:head"), (rng.choice(["Lee", "Kim"]), "PERSON:tail")] if rng.random() < 0.5 else [(rng.choice(["a", "b", "Lee", "Ann"]), "OTHER")]
        rows += [(s, i, w, "cap" if w[0].isupper() else "low", y) for i, (w, y) in enumerate(words)]
    df = spark.createDataFrame(rows, "s int, i int, word string, shape string, label string")
    wide = svm.window_features(df, ["s"], "i", ["word", "shape"])
    models = svm.train(wide.where("s < 40").coalesce(1), size=1 << 10, rounds=8)
    assert set(models) == {"OTHER", "PERSON:head", "PERSON:tail"}
    found = svm.label_entities(svm.probabilities(wide.where("s >= 40").drop("label"), models, 1 << 10), ["s"], "i")
    want = {(s, i): y for s, i, _, _, y in rows if s >= 40}
    got = {(r["s"], r["i"]): r["label"] for r in found.collect()}
    assert got.keys() == want.keys() and np.mean([got[k] == want[k] for k in want]) > 0.95


def test_rules_compiled_match_spans_and_plain_places_search_nothing(spark, monkeypatch):
    import random

    from glossa.operators import rules as r

    draw = random.Random(5)
    notations = ["[pos=a]", "[pos=a|b]", "[pos=^a]", "[f]", "[^f]", "[f & g]", "[&single]", "[pos=a f]", "[pos=a]*", "[pos=b]? [pos=a]", "[pos=a] [f]", "[pos=c]*[f]"]
    side = lambda none: draw.choice([none, (), *map(r.parse_pattern, notations)])
    functions = {"single": lambda u, i, _: len(u[i].attributes["surface"]) == 1}
    for _ in range(3000):
        units = [r.Unit({"pos": draw.choice("abc"), "surface": draw.choice(("x", "xy"))}, draw.sample(["f", "g:1", "h"], draw.randrange(3))) for _ in range(draw.randrange(1, 6))]
        rule = r.Rule(("z",), draw.choice([None, *map(r.parse_pattern, notations)]), side(None), side(None))
        span = r.compiled(rule, functions)
        assert [span(units, i) for i in range(len(units))] == [rule.span(units, i, functions) for i in range(len(units))]

    def refuse(*_):
        raise AssertionError("a state search for one place")

    monkeypatch.setattr(r, "lengths", refuse)
    units = [r.Unit({"pos": p}) for p in "aab"]
    r.apply((r.Rule(("z",), r.parse_pattern("[pos=a]"), r.parse_pattern("[pos=a]"), r.parse_pattern("[pos=b]")),), units)
    assert [u.features for u in units] == [[], ["z"], []]


def test_rules_over_batches_of_any_size(spark, monkeypatch):
    from pyspark.sql import functions as F

    from glossa.operators import rules as r

    rows = spark.range(50).select("id", F.transform(F.sequence(F.lit(1), F.col("id").cast("int")), lambda i: F.struct(F.when(i % 3 == 0, "a").when(i % 3 == 1, "b").alias("pos"))).alias("units"))
    rows = rows.select("id", F.when(F.col("id") > 1, F.col("units")).alias("units"))
    sets = [r.RuleSet("k", (r.Rule(("x", "y:1"), r.parse_pattern("[pos=a]")),))]
    got = {x["id"]: x["features"] for x in r.apply_sets(rows, sets, ["id"]).collect()}
    assert got == {i: [] if i < 2 else [["x", "y:1"] if k % 3 == 0 else [] for k in range(1, i + 1)] for i in range(50)}


def test_sequences_side_by_side_are_decoded_as_one_by_one():
    import numpy as np

    from glossa.operators import crf

    draw = np.random.default_rng(3)
    for apart in (False, True):
        sizes = [0, *draw.integers(0, 9, 40), 30, 0]
        n = int(sum(sizes))
        unary, pair = draw.integers(0, 3, (n, 4)).astype(float), draw.integers(0, 3, (n, 4, 4) if apart else (4, 4)).astype(float)  # many ties
        ends = np.r_[0, np.cumsum(sizes)]
        one_by_one = [y for a, b in zip(ends[:-1], ends[1:], strict=True) if b > a for y in crf.viterbi(unary[a:b], pair[a:b] if apart else pair)]
        assert crf.viterbi_many(unary, pair, sizes).tolist() == one_by_one
    p, sizes = draw.random((60, len(crf.ENTITY_LABELS))), [7, 0, 1, 52]
    barred = draw.random(60) < 0.3
    apart = [y for a, b in ((0, 7), (7, 8), (8, 60)) for y in crf.decode_entities(p[a:b], barred[a:b])]
    assert crf.decode_entities_many(p, sizes, barred) == apart
    assert all(crf.may_follow(a, b) for a, b in zip([None, *apart[:7]], [*apart[:7], None], strict=True))


def test_entities_and_tags_inside_the_row(spark, monkeypatch):
    import numpy as np

    from glossa.operators import crf
    from glossa.operators.entities import entity_arrays, entity_spans

    sents = [["Anna", "of", "x", "y", "z", "1"], [], ["a"], ["A", "B"]]
    labels = [["PERSON:single", "OTHER", "PERSON:head", "PERSON:middle", "PERSON:tail", "DATE:single"], [], ["OTHER"], ["TIME:head", "TIME:tail"]]
    rows = spark.createDataFrame([(i, s, y) for i, (s, y) in enumerate(zip(sents, labels, strict=True))], "id int, tokens array<string>, labels array<string>")
    flat = rows.selectExpr("id", "posexplode(arrays_zip(tokens, labels)) as (at, m)").selectExpr("id", "at", "m.tokens as surface", "m.labels as label")
    wanted = sorted(map(tuple, entity_spans(flat, ["id"], "at").collect()))
    assert sorted(map(tuple, rows.select("id", entity_arrays("tokens", "labels").alias("e")).selectExpr("id", "inline(e)").collect())) == wanted and len(wanted) == 4

    data = [([[w] for w in s], ["N" if w[0].isupper() else "O" for w in s]) for s in sents if s]
    plans = [(t, f, crf.train(f, data)) for t in (["U0:%x[0,0]", "B"], ["U0:%x[-1,0]/%x[1,0]", "U1:%x[0,0]", "U2", "B:%x[0,0]", "B"]) for f in [crf.Features.build(t, data)]]
    wanted = [[[f.labels[i] for i in crf.viterbi(*crf.potentials(f, w, f.encode(crf.columns(s))))] if s else [] for s in sents] for _, f, w in plans]
    for (_, f, w), tags in zip(plans, wanted, strict=True):
        assert [r["tags"] for r in crf.tag(rows, ["id"], f, w).orderBy("id").collect()] == tags
        flat = [[x] for s in sents for x in s]
        unary, pair = crf.Scores(f, w).potentials(flat, [len(s) for s in sents])
        assert np.array_equal(unary[:6], crf.potentials(f, w, f.encode(flat[:6]))[0]) and pair.shape[-1] == 2


def test_equal_predicates_are_assigned_once(spark, monkeypatch):
    import pyarrow as pa  # noqa: F401
    from pyspark.sql import functions as F

    from glossa.operators import frames as fr

    slots = [("ga", 0.5, False, False, ["A", "N"], [3.0, 1.0]), ("wo", 0.4, False, False, ["R"], [float("nan")])]
    one, two = [("eat", 0.6, slots)], [("eat", 0.1, slots[:1]), ("go", 0.3, slots)]
    data = [(i, [("A", ["ga"], False), (None if i % 2 else "N", ["ga", "wo"], True)][: i % 3], one if i % 4 else two) for i in range(24)]
    rows = spark.createDataFrame(data, f"id int, elements {fr.ELEMENTS}, frames {fr.FRAMES}")
    got = [(r["id"], r["rank"], r["frame_id"], str(r["score"]), r["slots"]) for r in fr.assign_frames(rows, ["id"], 2).orderBy("id", "rank").collect()]
    wanted = []
    for i, es, fs in data:
        known = [fr.Frame(n, p, tuple(fr.Slot(c, dict(zip(w, x, strict=True)), f, o, a) for c, f, o, a, w, x in s)) for n, p, s in fs]
        best = fr.best_frames(tuple(fr.Element(w, tuple(c), a) for w, c, a in es), known, 2)
        wanted += [(i, k + 1, name, str(score), list(at)) for k, (score, name, at) in enumerate(best)]
    assert got == wanted
    plan = fr.assign_frames(rows.select("id", "elements", F.col("frames")), ["id"], 2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1  # twice before: a filter inferred from the explode ran it again


def test_segmented_batches_are_handed_on_in_pieces(monkeypatch):
    import pandas as pd

    from glossa.operators import lattice as la

    monkeypatch.setattr(la, "HELD", 10)
    trie, grammar = la.Trie([]), la.Grammar({"Space": 1.0})
    texts = pd.DataFrame({"k": range(50), "t": ["ab cd ef"] * 49 + [None]})
    pieces = list(la.segment_frames([texts], "k", "t", trie, grammar))
    assert max(map(len, pieces)) < 10 + 5 and sum(map(len, pieces)) == 49 * 5 and list(pd.concat(pieces)["k"]) == [k for k in range(49) for _ in range(5)]
