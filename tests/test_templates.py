"""Masking, inference, compilation and matching."""

import itertools
import random
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from logtrends.functions import text
from logtrends.operators import inference, templates
from logtrends.sources import logs

WORDS = ["A", "B", "C", "D", "<*>"]
shape_lists = st.lists(st.lists(st.sampled_from(WORDS), min_size=1, max_size=6).map(" ".join), min_size=1, max_size=12)


def merge_shapes(group):
    """The greedy rule in its plainest form: all shapes of a group in one list."""
    pending = sorted(set(group), key=lambda s: (s.count(" "), s))
    found = []
    while pending:
        seed, pending = pending[0], pending[1:]
        shared = (p for p in pending if (set(seed.split(" ")) & set(p.split(" "))) - {"<*>"})
        merged = next((m for m in (templates.common_template(seed, p) for p in shared) if m), None)
        if merged:
            pending = [s for s in pending if not templates.template_matcher(merged).fullmatch(s)]
        found.append(merged or seed)
    return found


def merge_in_rounds(group, words, first_block):
    """The rounds of ``infer_templates`` on plain lists."""
    rows, at = [], 0
    for shape in sorted(set(group), key=lambda s: (s.count(" "), s)):
        rows.append((at, shape, inference.NEVER))
        at += len(shape.split(" "))
    found, hand = [], []
    while rows or hand:
        n = size = 0
        while n < len(rows) and size < words:
            size += len(rows[n][1].split(" "))
            n += 1
        now, rows = rows[:n], rows[n:]
        new, hand = inference.run_blocks(hand, now, not rows, first_block)
        found += new
        rows = inference.left_of(rows, [f[:2] for f in new if f[2]], hand)
    return [t for _, t, _ in sorted(found)]


def lines_df(spark, *texts, log="log1"):
    return spark.createDataFrame([(log, i, t) for i, t in enumerate(texts, 1)], "log_id string, line_no bigint, line string")


def pattern_df(spark, *patterns):
    df = spark.createDataFrame(list(enumerate(patterns)), "template_id int, pattern string")
    return templates.compile_templates(df)


def collapse(shape):
    return " ".join(w for w, before in zip(shape.split(" "), ["", *shape.split(" ")]) if not (w == before == "<*>"))


@pytest.mark.parametrize("left,right,expected", [
    ("Sent <*> rows", "Sent <*> lines", "Sent <*>"),
    ("A X B C", "A B Y C", "A <*> B <*> C"),
    ("X A B", "A B", "<*> A B"),
    ("alpha beta", "gamma delta", None),
    ("A", "A B", "A <*>"),
])
def test_common_template(left, right, expected):
    assert templates.common_template(left, right) == expected


@settings(max_examples=400, deadline=None)
@given(shape_lists)
def test_merge_covers_everything(shape_list):
    shape_list = [collapse(s) for s in shape_list]
    merged = merge_shapes(shape_list)
    matchers = [templates.template_matcher(m) for m in merged]
    assert all(any(m.fullmatch(s) for m in matchers) for s in shape_list)
    assert merged == merge_shapes(shape_list[::-1])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(WORDS), min_size=1, max_size=6), st.lists(st.sampled_from(WORDS[:4]), min_size=1, max_size=7))
def test_matcher_is_subsequence_with_gaps(template, words):
    template = collapse(" ".join(template)).split(" ")

    def covers(t, w):
        if not t:
            return not w
        if t[0] == "<*>":
            return any(covers(t[1:], w[i:]) for i in range(len(w) + 1))
        return bool(w) and t[0] == w[0] and covers(t[1:], w[1:])

    matched = bool(templates.template_matcher(" ".join(template)).fullmatch(" ".join(words)))
    assert matched == covers(template, words)


def test_lcs_table_matches_plain_recursion():
    rng = random.Random(1)
    for _ in range(100):
        a, b = [[rng.choice("abc") for _ in range(rng.randint(1, 7))] for _ in range(2)]
        best = max(
            len(c) for n in range(len(a) + 1) for c in itertools.combinations(a, n)
            if re.match(".*".join(["", *c]), "".join(b))
        )
        assert templates.lcs_table(a, b)[-1, -1] == best


def test_common_template_matches_the_whole_table():
    rng = random.Random(3)

    def with_whole_table(a, b):
        table, i, j, out = templates.lcs_table(a, b), len(a), len(b), []
        while i or j:
            if i and j and a[i - 1] == b[j - 1]:
                word, i, j = a[i - 1], i - 1, j - 1
            elif j and (not i or table[i, j - 1] > table[i - 1, j]):
                word, j = "<*>", j - 1
            else:
                word, i = "<*>", i - 1
            out.append(word)
        return collapse(" ".join(out[::-1]))

    for longest in (1, 3, 12, 80):
        for _ in range(150):
            a, b = [[rng.choice("abcdef") for _ in range(rng.randint(1, longest))] for _ in range(2)]
            found = templates.common_template(" ".join(a), " ".join(b))
            assert (found or "<*>") == with_whole_table(a, b)


def test_mask(spark, rows):
    df = lines_df(
        spark, "at 12:30 2018-04-01 done 5", "10ms 10.0.0.1 id=5 5h 3rd 40% +1,000.5", "May be Monday, now", "x<*> <*> 7 y",
        "2018-04-01T10:00:00Z end", " lead  more   spaces ", "one thing",
    )
    assert [r[0] for r in df.orderBy("line_no").select(text.shape(F.col("line"))).collect()] == [
        "at <*> done <*>", "10ms 10.0.0.1 id=5 <*>", "<*> be Monday, now", "x<*> <*> y", "<*> end", "lead more spaces", "<*> thing",
    ]
    with_ip = df.filter("line_no = 2").select(text.shape(F.col("line"), ("ipv4",))).first()[0]
    assert with_ip == "10ms <*> id=5 <*>"


def test_long_runs_do_not_overflow(spark):
    many = " ".join(["7"] * 200_000)
    words = " ".join(["word"] * 200_000)
    df = spark.createDataFrame([(many,), (words,), ("the " * 100_000,)], "line string")
    shown = [r[0] for r in df.select(text.shape(F.col("line"))).collect()]
    assert shown[0] == "<*>" and shown[1] == words


def test_verb_key(spark):
    df = lines_df(spark, "Worker is Starting 3 jobs", "nothing here", "10 failed, retrying failed")
    shown = [r[0] for r in df.orderBy("line_no").select(text.flat_key(text.verb_key(F.col("line")))).collect()]
    assert shown == ["is@1 Starting@2", "", "retrying@2 failed@3"]


def test_text_pattern(spark, rows):
    df = lines_df(spark, "abcXd*f tail", "zabcXd*f", "abcd*f", "abcXXd*")
    found = templates.match_lines(df, pattern_df(spark, r"abc*d\*f"), "all")
    assert rows(found, "line_no") == [(1,)]


def test_special_characters_are_literal(spark, rows):
    source = ["a.b (c) [d] {e} | ^$ + ? \\ é 7x", "a*b stays", "tab\tin line"]
    df = lines_df(spark, *source)
    patterns = [r[0] for r in df.select(text.shape_to_text(text.shape(F.col("line")))).collect()]
    found = templates.match_lines(df, pattern_df(spark, *patterns), "all")
    assert sorted(set(rows(found, "line_no"))) == [(1,), (2,), (3,)] and found.count() == 3


@pytest.mark.parametrize("limit", [100, 0])
def test_policies(spark, rows, limit):
    table = pattern_df(spark, "job *", "job * done", "*", "xy*", "*e f")
    df = lines_df(spark, "job 7", "job 7 done", "idle", "xyz", "one e f", "job")
    expect = {
        "all": [(1, 0), (1, 2), (2, 0), (2, 1), (2, 2), (3, 2), (4, 2), (4, 3), (5, 2), (5, 4), (6, 2)],
        "first": [(1, 0), (2, 0), (3, 2), (4, 2), (5, 2), (6, 2)],
        "last": [(1, 2), (2, 2), (3, 2), (4, 3), (5, 4), (6, 2)],
        "most_specific": [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4), (6, 2)],
    }
    for policy, pairs in expect.items():
        found = templates.match_lines(df, table, policy, inline_limit=limit)
        assert sorted(rows(found, "line_no", "template_id")) == pairs, policy
        assert set(df.columns) <= set(found.columns)


@pytest.mark.parametrize("words", [1_000_000, 60])
def test_inferred_templates_are_looked_up_by_words(spark, rows, monkeypatch, words):
    """The same ids as by regular expressions, one line at a time, without a row per word of each line."""
    monkeypatch.setattr(templates, "TEMPLATE_WORDS", words)
    rng = random.Random(5)
    made = {" ".join(rng.choice(["A", "B", "C", "D", "E", "the", "the", "<*>"]) for _ in range(rng.randint(1, 6))) for _ in range(70)}
    made = sorted({re.sub(r"<\*>( <\*>)+", "<*>", m) for m in made} | {"<*>", "A B C"})
    lines = [" ".join(rng.choice(["A", "B", "C", "D", "E", "the", "x7"]) for _ in range(rng.randint(1, 9))) for _ in range(150)] + ["  A   B C ", "A\tB C", "x7", "x7"]
    df, table = lines_df(spark, *lines), templates.number_templates(spark.createDataFrame([(m,) for m in made], "shape string")).cache()
    known = rows(table, "template_id", "pattern", "n_literals")
    expected = {
        at: [(i, n) for i, pattern, n in known if templates.template_matcher(pattern).fullmatch(re.sub(" {2,}", " ", line.strip(" ")))]
        for at, line in enumerate(lines, start=1)}
    monkeypatch.setattr(templates, "_match_by_anchor", None)
    for policy, order in {"first": lambda t: t[0], "last": lambda t: -t[0], "most_specific": lambda t: (-t[1], t[0])}.items():
        best = {at: sorted(found, key=order) for at, found in expected.items()}
        assert dict(rows(templates.match_lines(df, table, policy, inline_limit=0), "line_no", "template_id")) == {at: f[0][0] for at, f in best.items() if f}
        every = templates.match_sets(df, table, policy, inline_limit=0)
        assert dict(rows(every, "line_no", "template_ids")) == {at: [i for i, _ in f] for at, f in best.items() if f} and every.columns == [*df.columns, "template_ids"]


@pytest.mark.parametrize("few, common", [(3, 32), (0, 10**9), (0, 4)])
def test_lines_told_from_sets_are_those_that_templates_cover(monkeypatch, few, common):
    """All matches, and the first one before a given rank, as one comparison at a time gives them."""
    monkeypatch.setattr(inference, "FEW", few)
    monkeypatch.setattr(inference, "COMMON", common)
    rng = random.Random(3)
    made = sorted({collapse(" ".join(rng.choice([*WORDS, "E", "<*>"]) for _ in range(rng.randint(1, 6)))) for _ in range(300)})
    lines = sorted({" ".join(rng.choice(["A", "B", "C", "D", "E", "x"]) for _ in range(rng.randint(1, 9))) for _ in range(200)}) + ["", "  "]
    ranked = [((i,), m) for i, m in enumerate(made)]
    every = {(i, rank) for rank, m in ranked for i, line in enumerate(lines) if templates.template_matcher(m).fullmatch(line)}
    assert set(inference.match_all(lines, ranked)) == every
    equal = [(rng.randrange(300),) if rng.random() < 0.5 else None for _ in lines]
    first = {}
    for i, rank in sorted(every):
        if equal[i] is None or rank < equal[i]:
            first.setdefault(i, rank)
    assert dict(inference.match_all(lines, ranked, equal)) == first
    assert list(inference.match_all([], ranked)) == []


def test_a_line_is_compared_with_few_of_the_templates_whose_words_it_has(monkeypatch):
    """Lines with all the common words meet hardly any of the templates that have these in another order."""
    calls, covers = [], inference.Template.covers
    monkeypatch.setattr(inference.Template, "covers", lambda self, text: calls.append(text) or covers(self, text))
    rng, words = random.Random(9), [f"w{i}" for i in range(10)]
    made = [" <*> ".join(rng.sample(words, 10)) for _ in range(200)]
    lines = sorted({" z ".join(rng.sample(words, 10)) for _ in range(200)} | {made[7].replace("<*>", "z")})
    assert [rank for _, rank in inference.match_all(lines, [((i,), m) for i, m in enumerate(made)])] == [(7,)]
    assert len(calls) < len(lines) * len(made) / 100


def test_lines_do_not_move_for_the_templates_with_wildcards(spark, monkeypatch):
    """One shuffle by the line, to meet equal templates; none by block and share of the templates."""
    monkeypatch.setattr(templates, "TEMPLATE_WORDS", 6)
    made = [f"a{i} <*> b{i}" for i in range(9)] + ["a1 x b1"]
    table = templates.number_templates(spark.createDataFrame([(m,) for m in made], "shape string")).cache()
    found = templates.match_lines(lines_df(spark, *[f"a{i} x b{i}" for i in range(9)]), table, "first", inline_limit=0)
    assert found.count() == 9
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" not in plan and "MapInArrow" in plan


@pytest.mark.parametrize("limit", [100, 0])
def test_unmatched(spark, rows, limit):
    df = lines_df(spark, "job 7", "idle", "job")
    assert rows(templates.unmatched_lines(df, pattern_df(spark, "job *"), limit), "line") == [("idle",), ("job",)]
    assert templates.unmatched_lines(df, pattern_df(spark, "job *").limit(0), limit).count() == 3


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*WORDS, "E", "F", "G"]), min_size=1, max_size=6).map(" ".join), min_size=1, max_size=25),
       st.sampled_from([1, 4, 10, 40]), st.sampled_from([1, 3, 15]))
def test_rounds_give_what_one_list_gives(shape_list, words, first_block):
    shape_list = [collapse(s) for s in shape_list]
    assert merge_in_rounds(shape_list, words, first_block) == merge_shapes(shape_list)


def test_runs_of_words_match_as_the_expression_does():
    rng = random.Random(4)
    for _ in range(4000):
        template, shape = (collapse(" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 7)))) for _ in range(2))
        assert inference.Template(0, template).covers(shape) == bool(templates.template_matcher(template).fullmatch(shape)), (template, shape)


def test_infer_is_the_greedy_rule_at_every_size(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["start", "stop", "node", "5", "disk", "is", "full", "10:30", f"w{i % 9}"]) for _ in range(rng.randint(1, 7)))
             for i in range(300)]
    texts += ["same  line  here"] * 50
    df = lines_df(spark, *texts)
    groups = {}
    for key, shape in templates.shapes(df).select("verb_key", "shape").collect():
        groups.setdefault(key, []).append(shape)
    expected = sorted({t for group in groups.values() for t in merge_shapes(group)})
    for words in (200_000, 400, 150):
        found = templates.infer_templates(df.repartition(7), words)
        assert sorted(r.pattern for r in found.collect()) == expected
    assert templates.unmatched_lines(df, found).count() == 0
    assert templates.unmatched_lines(df, found, 0).count() == 0
    ids = [r.template_id for r in found.orderBy(F.col("n_literals").desc(), "pattern").collect()]
    assert ids == list(range(len(ids)))


def test_seeds_that_wait_are_decided_by_reservations(spark):
    """Seeds whose partners stand far behind, more than a task may hold; some words are shared by seeds, some partners have only a wildcard in common."""
    rng = random.Random(11)
    texts = [f"x{i} a{i}" for i in range(12)] + [f"x{i} b{i} c{i} d{i} e{i % 5} f" for i in range(0, 12, 2)] + [f"e{i} 5" for i in range(5)]
    texts += [" ".join(rng.choice(["5", "u", "v", f"w{i % 6}"]) for _ in range(rng.randint(1, 4))) for i in range(20)] + ["7 z", "z 8", "9 z q 5"]
    df = lines_df(spark, *texts)
    groups = {}
    for key, shape in templates.shapes(df).select("verb_key", "shape").collect():
        groups.setdefault(key, []).append(shape)
    expected = sorted({t for group in groups.values() for t in merge_shapes(group)})
    for words in (9, 25):
        assert sorted(r.pattern for r in templates.infer_templates(df, words).collect()) == expected


def test_infer_golden(spark, rows):
    found = templates.infer_templates(lines_df(spark, "Sent 3 rows", "Sent 4 rows", "alpha beta"))
    assert rows(found, "pattern") == [("Sent <*> rows",), ("alpha beta",)]
    assert templates.infer_templates(lines_df(spark, "x").filter("false")).count() == 0


def test_template_file(spark, rows, tmp_path):
    (tmp_path / "t.txt").write_text("b *\n\n  a\\*c \n*\n")
    table = logs.read_template_text(spark, str(tmp_path / "t.txt"))
    assert rows(table, "template_id", "pattern") == [(0, "b *"), (1, "a\\*c"), (2, "*")]
