"""Small fixtures, one for each semantic trap."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import maths, nested, text
from millrace.operators import grounding, match, ordering, rules, sequence, snapshot, stats, tree
from millrace.streaming import replay


def col(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x"))).first()[0]


def test_one_run_has_no_spread(spark):
    row = stats.moments(spark.createDataFrame([("a", 2.0)], "config string, m double"), ["config"], ["m"]).first()
    assert (row.m_mean, row.m_stddev) == (2.0, 0.0)


def test_no_runs_give_zeros(spark):
    row = stats.moments(spark.createDataFrame([], "m double"), [], ["m"]).first()
    assert tuple(row) == (0.0, 0.0, 0.0, 0.0)


def test_rate_at_threshold(spark):
    df = spark.createDataFrame([(True, 0.5), (False, 0.5)], "should boolean, rate double")
    assert [r[0] for r in df.select(stats.passes(F.col("rate"), F.col("should"), 0.5)).collect()] == [True, False]


def test_confusion_without_positives(spark):
    row = stats.confusion(spark.createDataFrame([(False, False)], "a boolean, p boolean"), F.col("a"), F.col("p")).first()
    assert (row.precision, row.recall, row.accuracy) == (1.0, 1.0, 1.0)


def test_mode_tie_goes_to_the_first_seen_and_needs_support(spark):
    df = spark.createDataFrame([("k", 9.0, 5, 1), ("k", 8.0, 5, 0), ("k", 1.0, 1, 2)], "k string, v double, w int, o int")
    assert stats.weighted_mode(df, ["k"], F.col("v"), F.col("w"), F.col("o"), 0.2).first().mode == 8.0
    assert stats.weighted_mode(df, ["k"], F.col("v"), F.col("w"), F.col("o"), 0.9).first().mode is None


def test_index_percentiles_of_few_and_many(spark):
    df = spark.createDataFrame([("few", i) for i in range(5)] + [("many", i) for i in range(20)], "k string, v int")
    got = {r.k: (r.low, r.high) for r in stats.index_percentiles(df, ["k"], "v", []).collect()}
    assert got == {"few": (0, 4), "many": (2, 17)}


def test_keep_one_prefers_strict_at_the_first_place(spark):
    df = spark.createDataFrame([(1, True, 0), (1, False, 5), (1, False, 7)], "fig int, loose boolean, ord int")
    row = sequence.keep_one(df, "fig", [F.col("loose")], ["ord"]).first()
    assert (row.ord, row.position) == (5, 0)


def test_numbering_gaps_and_duplicates(spark):
    df = spark.createDataFrame([("p", n) for n in (1, 2, 4, 4, 6)], "p string, n int")
    assert sorted(r.n for r in match.numbering_gaps(df, ["p"], "n").collect()) == [3, 5]


def test_gap_clusters_drop_singletons(spark):
    df = spark.createDataFrame([("p", float(v)) for v in (50, 60, 200, 205, 500)], "p string, x double")
    got = sorted((r.low, r.high, r.gutter) for r in sequence.widest_clusters(df, ["p"], "x", [], 100).collect())
    assert got == [(50.0, 60.0, 130.0), (200.0, 205.0, None)]


def test_last_kept_is_not_lag(spark):
    df = spark.createDataFrame([("s", i, [i * 0.0004]) for i in range(6)], "s string, i int, v array<double>")
    assert sorted(r.i for r in sequence.last_kept(df, ["s"], "i", "v", 0.9995).collect()) == [0, 2, 4]


@pytest.mark.parametrize(("levels", "numbers"), [([2, 3, 3, 2, 1], ["1", "1.1", "1.2", "2", "1"]), ([1, 2, 2, 1, 2], ["1", "1.1", "1.2", "2", "2.1"])])
def test_numbering(spark, levels, numbers):
    df = spark.createDataFrame([("d", i, n) for i, n in enumerate(levels)], "d string, i int, level int")
    assert [r.number for r in sequence.numbering(df, ["d"], "i", "level").orderBy("i").collect()] == numbers


def test_tagged_fence_inside_a_fence_is_content(spark):
    lines = ["a", "```py", "x", "```js", "y", "```", "b"]
    got = col(spark, sequence.fences, lines, "array<string>")
    assert [(b.start, b.lang, b.lines) for b in got] == [(2, "py", ["x", "```js", "y"])]


def test_balance_starts_again_at_zero(spark):
    df = spark.createDataFrame([([-1, 1, 1, -1],)], "m array<int>")
    bad, depth = sequence.balance(F.col("m"))
    assert tuple(df.select(bad, depth).first()) == (1, 1)


def test_trailing_and_sample_places(spark):
    assert col(spark, lambda x: sequence.trailing(x, lambda v: v == ""), ["a", "", ""], "array<string>") == 2
    assert col(spark, lambda x: sequence.trailing(x, lambda v: v == ""), ["", ""], "array<string>") == 2
    assert col(spark, sequence.sample_places, 13, "int") == [0, 2, 5, 7, 10]
    assert col(spark, sequence.sample_places, 0, "int") == []


def test_decimation_keeps_all_below_twice_the_bound(spark):
    df = spark.createDataFrame([("a", i) for i in range(23)] + [("b", i) for i in range(24)], "k string, i int")
    assert {r.k: r["count"] for r in sequence.decimate(df, ["k"], "i").groupBy("k").count().collect()} == {"a": 23, "b": 12}


def test_each_key_is_classified_once(spark):
    old = spark.createDataFrame([("same", "1"), ("moved", "1"), ("gone", "1")], "k string, t string")
    new = spark.createDataFrame([("same", "1"), ("moved", "2"), ("fresh", "1")], "k string, t string")
    assert {r.k: r.change for r in match.changes(old, new, "k", "t").collect()} == {"same": "UNCHANGED", "moved": "MODIFIED", "gone": "DELETED", "fresh": "NEW"}


def test_touched_but_equal_is_skipped_once_there_is_a_hash(spark):
    state = spark.createDataFrame([("a", "1", "h"), ("b", "1", "")], "k string, edited string, hash string")
    now = spark.createDataFrame([("a", "2", "h"), ("b", "2", "")], "k string, edited string, hash string")
    assert {r.k: r.action for r in snapshot.merge_state(state, now, "k").collect()} == {"a": "SKIP_HASH", "b": "UPDATE"}


def test_as_of_takes_strictly_earlier_marks(spark):
    events = spark.createDataFrame([("u", 5, 1), ("u", 9, 2)], "u string, t int, id int")
    marks = spark.createDataFrame([("u", 5, 10), ("u", 7, 11)], "u string, t int, id int").withColumn("seen", F.col("id"))
    assert sorted((r.id, r.as_of) for r in match.as_of(events, marks, ["u"], "t", ["id"], "seen", -1).collect()) == [(1, -1), (2, 11)]


def test_containment_is_exact(spark):
    texts = spark.createDataFrame([(1, "xa b c dy"), (2, "a b c e"), (3, "zz"), (4, "k1 k2 k3 k4 k5 k6 k7 k8 k9 k10 k11 k12 and")], "d int, text string")
    items = spark.createDataFrame([(7, "a b c d"), (8, "z"), (9, "k1 k2 k3 k4 k5 k6 k7 k8 k9 k10 k11 k12")], "i int, text string")
    assert sorted(tuple(r) for r in match.contained(texts, items, "d", "i").collect()) == [(1, 7), (3, 8), (4, 9)]


def test_overlap_of_touching_ends_is_none(spark):
    a = spark.createDataFrame([("k", 1, 0, 10), ("k", 2, 10, 20), ("k", 3, 5, 95)], "key string, id int, low int, high int")
    got = sorted((r.a_id, r.b_id) for r in match.overlaps(a, a, "key", 7).where("a_id < b_id").collect())
    assert got == [(1, 3), (2, 3)]


def test_snippet_of_nothing_passes(spark):
    lines = spark.createDataFrame([("d", 1, "x = 1"), ("d", 1, "gone")], "d string, s int, line string")
    sources = spark.createDataFrame([("d", "  x = 1  # note")], "d string, source string")
    row = snapshot.grounded(lines, sources, ["d"], ["s"], 0.7).first()
    assert (row.countable, row.matched, row.ok) == (2, 1, False)


def test_citations_in_order_of_verdicts(spark):
    refs = spark.createDataFrame([("a", 1, 3), ("a", 2, 9), ("a", 4, 2), ("b", 1, 1)], "path string, first int, last int")
    sizes = spark.createDataFrame([("a", 5)], "path string, lines int")
    assert sorted(r.verdict for r in match.references(refs, sizes).collect()) == ["missing_file", "ok", "out_of_range", "start_after_end"]


def test_natural_order(spark):
    df = spark.createDataFrame([("2-a",), ("10-b",), ("index",), ("overview",), ("x",)], "name string")
    assert [r.name for r in ordering.natural_place(df, "name").orderBy("place").collect()] == ["index", "overview", "2-a", "10-b", "x"]
    keys = spark.createDataFrame([("2",), ("10",), ("2-1",)], "p string")
    assert [r.p for r in keys.orderBy(ordering.prefix_key(F.col("p"))).collect()] == ["2", "2-1", "10"]


def test_page_and_half(spark):
    df = spark.range(5)
    last = ordering.page(df, ["id"], 3, 5).collect()
    assert [(r.id, r.total, r.has_more, r.next_offset) for r in last] == [(3, 5, False, None), (4, 5, False, None)]
    assert [tuple(r) for r in ordering.half(df, ["id"], 3).collect()] == [(0, True), (1, True)]


def test_tree(spark):
    nodes = spark.createDataFrame([("a", None, 0), ("b", "a", 1), ("c", "a", 0), ("d", "b", 0)], "n string, p string, o int")
    walked = tree.walk(nodes, "n", "p", "o")
    assert [r.n for r in walked.orderBy("path").collect()] == ["a", "c", "b", "d"]
    assert {r.n: r.pages for r in tree.subtree_sizes(walked, "n").collect()} == {"a": 4, "b": 2, "c": 1, "d": 1}
    mapped = spark.createDataFrame([("a",)], "n string")
    assert {r.n: r.ancestor for r in tree.nearest_mapped(nodes, mapped, "n", "p").collect()} == dict.fromkeys("abcd", "a")
    assert col(spark, tree.indent_parents, [0, 2, 4, 2], "array<int>") == [None, 0, 1, 0]
    with pytest.raises(ValueError, match="deeper"):
        tree.walk(nodes, "n", "p", "o", most=1)


def test_text_functions(spark):
    assert col(spark, text.slug, "The **Big** `API`, v2!") == "the-big-api-v2"
    assert col(spark, text.md_words, "a big 文字 word|x `yy`") == 6
    assert col(spark, text.squeezed, " a  b\n") == "a b"
    assert col(spark, lambda x: text.last_tag(x, "r"), "<r>1</r><r> 2\n</r>") == "2"
    assert col(spark, lambda x: text.last_tag(x, "r"), "none") is None
    assert col(spark, text.file_name, "") == "untitled"
    assert col(spark, text.comment_only, "  # x") is True
    assert [col(spark, text.dashes, x) for x in ("| ———— | –|", "|———|:––|", "— |", "||")] == ["|----|---|", "|———|:––|", "— |", "||"]
    docs = spark.createDataFrame([("d", "see `a/b.py:3-9` and `c.md:4`\n```\n`x.py:1`\n```\n`localhost:3000` `/z.go:7`")], "file string, text string")
    assert sorted((r.line, r.path, r.first, r.last) for r in grounding.citations(docs).collect()) == [(1, "a/b.py", 3, 9), (1, "c.md", 4, 4), (5, "z.go", 7, 7)]
    assert [col(spark, text.file_prefix_issue, x) for x in ("1-a.md", "01-a.md", "a.md", "1-A.md")] == [None, "zero_padded", "no_prefix", "not_kebab"]
    assert [col(spark, text.skill_name_issue, x) for x in ("a-b", "A", "-a", None, "a" * 65)] == [None, "not_kebab", "bad_dash", "missing", "too_long"]


@pytest.mark.parametrize("name", sorted(maths.CURVES))
def test_curves_run_from_0_to_1(spark, name):
    got = spark.createDataFrame([(0.0,), (1.0,)], "t double").select(maths.ease(name, F.col("t")).cast("double")).collect()
    assert [r[0] for r in got] == pytest.approx([0.0, 1.0], abs=1e-9)


def test_nested_functions(spark):
    df = spark.createDataFrame([((1, "x", [(2, "y")]),)], "body struct<b:int,token:string,a:array<struct<z:int,token:string>>>")
    assert df.select(nested.canonical_json(df.schema, "body", ("token",))).first()[0] == '{"a":[{"z":2}],"b":1}'
    assert col(spark, nested.reversed_map, [("k1", "v"), ("k2", "v")], "array<struct<key:string,value:string>>") == {"v": "k1"}
    assert col(spark, nested.padded, [["a"], ["b", "c"]], "array<array<string>>") == [["a", ""], ["b", "c"]]
    assert col(spark, lambda x: nested.grid(x, F.lit(2)), [1, 2, 3], "array<int>") == [[1, 2], [3]]


def test_events_with_empty_ids_stay_apart(spark):
    df = spark.createDataFrame([("", "interrupt", 1), ("", "interrupt", 2), ("a", "x", 1), ("a", "x", 1)], "id string, kind string, at int")
    keyed = df.withColumn("key", replay.event_key(F.col("id"), F.col("kind"), F.col("at")))
    assert replay.dedupe_stream(keyed, "key", "at").count() == 3


def test_processed_state_wins(spark):
    df = spark.createDataFrame([("a", None), ("a", 5), ("b", None)], "id string, processed int")
    assert sorted((r.id, r.processed) for r in replay.last_state(df, "id", "processed").collect()) == [("a", 5), ("b", None)]


def test_front_matter_stops_at_the_first_failure(spark):
    good = "---\nname: a-b\ndescription: >\n  one\n  two\n---\n# T"
    assert col(spark, rules.front_matter, good) == {"name": "a-b", "description": "one two"}
    texts = spark.createDataFrame([("ok", good), ("open", "---\nname: x"), ("odd", "---\nname: x\ndescription: y\nother: z\n---\n"), ("none", "# x")], "k string, t string")
    assert {r.k: r.message for r in rules.front_matter_failure(texts, "k", "t").collect()} == {"open": "not closed", "odd": "unexpected other", "none": "no front matter"}
