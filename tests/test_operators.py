import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stepweave.functions.text import normalized
from stepweave.operators import checks, graphs, messages, planning, retrieval, rollups, sheets, steps, trees


def conversation(spark, roles):
    return spark.createDataFrame([(1, i + 1, r, f"t{i}") for i, r in enumerate(roles)], "conv_id long, turn long, role string, text string")


def turns(df):
    return [r.turn for r in df.orderBy("place").collect()]


def test_limiter_keeps_order(spark):
    six = conversation(spark, ["user", "assistant"] * 3)
    assert turns(messages.limit_messages(six, ["conv_id"], "turn", 3)) == [4, 5, 6]
    assert turns(messages.limit_messages(six, ["conv_id"], "turn", 3, compat=True)) == [5, 4, 6]
    assert turns(messages.limit_messages(six, ["conv_id"], "turn", 3, keep_first=True)) == [1, 5, 6]


def test_limiter_drops_a_tool_answer_at_the_edge(spark):
    assert turns(messages.limit_messages(conversation(spark, ["user", "tool", "assistant"]), ["conv_id"], "turn", 2)) == [3]


def cut_by_hand(tokens, most, each):
    """Newest first."""
    used, kept = 0, []
    for t in tokens:
        own = min(t, each)
        if used + each > most:
            kept.append(min(own, most - used))
            break
        kept.append(own)
        used += own
    return kept


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(tokens=st.lists(st.integers(0, 50), min_size=1, max_size=8), most=st.integers(1, 120), each=st.integers(1, 40))
def test_token_cut_equals_the_loop(spark, tokens, most, each):
    rows = spark.createDataFrame([(1, len(tokens) - i, t) for i, t in enumerate(tokens)], "c long, turn long, n long")
    found = messages.cut_tokens(rows, ["c"], "turn", F.col("n"), most, each).orderBy(F.desc("turn")).collect()
    assert [r.kept_tokens for r in found] == cut_by_hand(tokens, most, each)


def test_token_cut_fixture():
    assert cut_by_hand([30, 10, 40], 45, 20) == [20, 10, 15]


def test_history_of_a_step_is_a_prefix_of_the_next(spark):
    rows = conversation(spark, ["user"] * 5).withColumn("h", steps.history("text", ["conv_id"], ["turn"])).orderBy("turn").collect()
    assert [r.h for r in rows] == ["", "t0", "t0\nt1", "t0\nt1\nt2", "t0\nt1\nt2\nt3"]


def test_steps_need_both_images(spark):
    rows = conversation(spark, ["user"] * 3)
    images = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "conv_id long, turn long, image string")
    assert [(r.turn, r.image_before, r.image_after) for r in steps.with_both_images(rows, images, ["conv_id"], "turn", "image").collect()] == [(2, "a", "b")]


def test_uniform_sample_floors_its_stride(spark):
    shots = spark.range(99).selectExpr("1 as c", "id")
    assert sorted(r.id for r in steps.uniform_sample(shots, ["c"], ["id"], 50).collect()) == list(range(50))


def test_catch_up_is_never_negative(spark):
    expected = spark.createDataFrame([("a", 2), ("b", 1), ("c", 3)], "k string, expected long")
    existing = spark.createDataFrame([("a",), ("b",), ("b",)], "k string")
    assert {r.k: r.remaining for r in planning.catch_up(expected, existing, ["k"]).collect()} == {"a": 1, "c": 3}


def test_dedup_twice_is_dedup_once(spark):
    rows = spark.createDataFrame([(1, "A  b"), (2, "a b"), (3, "c")], "id long, t string")
    once = planning.first_occurrence(rows, "t", "id")
    twice = planning.first_occurrence(once.withColumnRenamed("norm", "t"), "t", "id")
    assert {(r.id, r.norm) for r in once.collect()} == {(r.id, r.norm) for r in twice.collect()} == {(1, "a b"), (3, "c")}


def test_first_match_or_fallback(spark):
    rows = spark.createDataFrame([(1, 1, "x", False), (1, 2, "y", True), (1, 3, "z", True), (2, 1, "x", False)], "k int, i int, v string, m boolean")
    found = {r.k: (r.chosen, r.method) for r in planning.first_match(rows, ["k"], "m", ["i"], "v", F.lit("f")).collect()}
    assert found == {1: ("y", "candidate_match"), 2: ("f", "fallback_direct")}


def test_orders_and_cycles(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    line, loop = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string"), spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    assert {r.node: r.layer for r in graphs.topological(nodes, line).collect()} == {"a": 0, "b": 1, "c": 2}
    assert graphs.topological(nodes, loop).count() == 0
    assert {r.node: r.layer for r in graphs.topological(nodes, loop, cycle="append").collect()} == {"c": 0, "a": 1, "b": 1}


def test_overlap_dedup_keeps_the_first(spark):
    boxes = spark.createDataFrame([(1, 0, "a", 0, 0, 10, 10), (1, 1, "a", 0, 4, 10, 10), (1, 2, "b", 0, 0, 10, 10), (1, 3, "a", 0, 90, 5, 5)], "t int, at int, norm string, x int, y int, w int, h int")
    assert sorted(r.at for r in trees.drop_overlaps(boxes, "t", "at", "norm").collect()) == [0, 2, 3]


def test_trees(spark):
    xml = "<d><application name='e' active='true'><b-button name='ok' visible='true' showing='true' enabled='true' screencoord='(1, 2)' size='(3, 4)'/></application></d>"
    nodes = trees.flatten(spark.createDataFrame([(1, xml), (2, None)], "k int, xml string"), "k", "xml")
    kept = nodes.where(trees.kept_node()).collect()
    assert [(r.name, r.x, r.h) for r in kept] == [("ok", 1, 4)]
    assert nodes.where(trees.kept_node("ubuntu", interactive=False)).count() == 1
    assert trees.active_applications(nodes, "k").first().apps == ["e", "gnome-shell"]


def test_nearest_skips_itself_and_breaks_ties_by_key(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 2.0])], "k long, v array<double>")
    assert {(r.query_id, r.k) for r in retrieval.nearest(rows, rows, "k", "v", 1).collect()} == {(1, 2), (2, 3), (3, 2)}
    assert {(r.query_id, r.k) for r in retrieval.within(rows, rows, "k", "v", 0.1).collect()} == {(2, 3), (3, 2)}


def test_chunks_fit_and_lose_no_line():
    text = "\n".join(f"line number {i}" for i in range(40))
    made = retrieval.chunks_of(text, 30, lambda t: len(t.split()), break_at_blank=False)
    assert all(len(c.split()) <= 30 for c in made)
    assert "\n".join(made) == text


def test_chunk_rules():
    words = lambda t: len(t.split())
    paragraphs = "\n".join(["a b c", "d e f", "", "g h i", "j k l", "", "m n o"])
    assert retrieval.chunks_of(paragraphs, 9, words) == ["a b c\nd e f", "g h i\nj k l\n\nm n o"]
    assert retrieval.chunks_of("one two three\nfour five six\nseven eight", 3, words, one_line=True) == ["one two three", "four five six", "seven eight"]
    lines = [f"line {i}" for i in range(8)]
    overlapped = retrieval.chunks_of("\n".join(lines), 6, words, break_at_blank=False, overlap=1)
    # the share of the lines that the budget is: under 6 / 16 * 8 = 3 of them at first, and all of the last three
    assert overlapped == ["line 0\nline 1", "line 1\nline 2", "line 2\nline 3", "line 3\nline 4", "line 4\nline 5", "line 5\nline 6\nline 7"]
    long = " ".join(f"w{i}" for i in range(40))
    broken = retrieval.chunks_of(long, 10, words)
    assert "".join(broken[:-1]).replace(" ", "") == "".join(long.replace(" ", "")[: len("".join(broken[:-1]).replace(" ", ""))]) and all(len(c) >= retrieval.LEAST_CHUNK for c in broken)
    assert retrieval.chunks_of("abc", 10, words) == [] and retrieval.chunks_of("", 1, words) == []
    assert retrieval.chunks_of("\n".join(["x y z"] * 4), 3, words, break_at_blank=True)[0] == "x y z"


def test_numbers_of_rows_across_partitions(spark):
    df = spark.range(500).select(((F.col("id") * 7919) % 500).alias("v")).repartition(5)
    assert sheets.numbered(df, "v", "at").where("at <> v").count() == 0
    wide = spark.range(1200).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert len(sheets.transpose(wide, "k").columns) == 1201
    with pytest.raises(ValueError):
        sheets.transpose(spark.range(sheets.WIDEST + 5).select(F.col("id").alias("k"), F.lit(1).alias("v")), "k")


def test_scores_skip_broken_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [1.0]), (7, [float("nan"), 1.0])], "k long, v array<double>")
    assert {(r.query_id, r.k) for r in retrieval.nearest(rows, rows, "k", "v", 3).collect()} == {(1, 2), (2, 1)}
    assert retrieval.nearest(rows.limit(0), rows, "k", "v", 1).count() == 0 == retrieval.nearest(rows, rows.limit(0), "k", "v", 1).count()


def test_pairs_of_boxes_come_once(spark):
    import random

    rnd = random.Random(4)
    rows = [(i % 3, i, "ab"[i % 2], rnd.randrange(300), rnd.randrange(300), rnd.randrange(0, 150), rnd.randrange(0, 150)) for i in range(150)]
    boxes = spark.createDataFrame(rows, "t int, at int, norm string, x int, y int, w int, h int")
    got = {(r.t, r.first, r.second): r.iou for r in trees.overlapping_pairs(boxes, "t", "at", "norm").collect()}

    def iou(p, q):
        w, h = min(p[3] + p[5], q[3] + q[5]) - max(p[3], q[3]), min(p[4] + p[6], q[4] + q[6]) - max(p[4], q[4])
        shared = max(0, w) * max(0, h)
        return shared / (p[5] * p[6] + q[5] * q[6] - shared) if shared else 0

    want = {(p[0], p[1], q[1]): iou(p, q) for p in rows for q in rows if p[0] == q[0] and p[2] == q[2] and p[1] < q[1] and iou(p, q) > 0.2}
    assert got == pytest.approx(want) and len(got) > 20
    assert trees.overlapping_pairs(boxes, "t", "at", "norm").count() == len(want)


def test_replayed_and_new_steps(spark):
    old, new = spark.createDataFrame([(1, 0), (1, 1)], "k int, i int"), spark.createDataFrame([(1, 0), (2, 0)], "k int, i int")
    assert sorted((r.k, r.segment, r.at) for r in steps.appended(old, new, ["k"], "i").collect()) == [(1, 0, 0), (1, 0, 1), (1, 1, 2), (2, 1, 0)]


def test_deep_orders(spark):
    nodes = spark.range(12).select(F.col("id").cast("string").alias("node"))
    edges = spark.range(11).select(F.col("id").cast("string").alias("src"), (F.col("id") + 1).cast("string").alias("dst"))
    assert {int(r.node): r.layer for r in graphs.topological(nodes, edges).collect()} == {i: i for i in range(12)}


def test_sheet_operations(spark):
    df = spark.createDataFrame([("a", "2"), ("b", "10")], "k string, v string")
    assert [r.k for r in sheets.column_sort(df, "v", ascending=False).collect()] == ["b", "a"]
    with pytest.raises(ValueError):
        sheets.column_sort(df.union(spark.createDataFrame([("c", "x")], "k string, v string")), "v")
    assert sheets.reorder(df, ["v"]).columns == ["v", "k"]
    assert {r.column: r.width for r in sheets.widths(df).collect()} == {"k": 1, "v": 2}
    changed = sheets.set_column(df, "k", "v", spark.createDataFrame([(1, "7")], "at int, value string"))
    assert {r.k: r.v for r in changed.collect()} == {"a": "2", "b": "7"}


def test_tables_equal(spark):
    a = spark.createDataFrame([(1, 1.00001), (2, None)], "k int, v double")
    assert checks.tables_equal(a, a.withColumn("v", F.col("v") + 1e-6)).first().score == 1
    assert checks.tables_equal(a, a.union(a.limit(1))).first().score == 0


def test_checks_by_name(spark):
    df = spark.createDataFrame([("the cat", "1.5")], "t string, n string")
    assert checks.all_checks(df, [("check_include_exclude", ("t", ["the"], ["dog"]), {}), ("check_text_enlarged", ("n",), {})]).first().score == 1
    assert checks.scored(df, "exact_match", "t", "n").first().score == 0
    assert checks.last_action_is(spark.createDataFrame([(1, "x"), (2, "fail")], "i int, a string"), "a", "i").first().score == 1
    assert checks.positions_contain(spark.createDataFrame([(1, "in Rome"), (2, "Oslo")], "i int, t string"), "i", "t", ["Rome", ["Bergen", "Oslo"]]).first().score == 1


def test_status_orders_differ(spark):
    done, n = F.lit(True), F.lit(9)
    full, brief = rollups.status_columns(done, F.lit(False), F.lit(False), F.lit(False), n, 5)
    row = spark.range(1).select(full.alias("f"), brief.alias("b")).first()
    assert (row.f, row.b) == ("Done", "Done (Max Steps)")


def test_observed_counts(spark):
    df, watch = rollups.observed(spark.range(10), even=F.col("id") % 2 == 0)
    df.collect()
    assert watch.get["even"] == 5


def test_normalized_key_is_one(spark):
    assert spark.createDataFrame([("a  B",), ("A b ",)], "t string").select(normalized("t")).distinct().count() == 1
