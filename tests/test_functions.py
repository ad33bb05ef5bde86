import datetime as dt

import pytest
from pyspark.sql import functions as F

from stepweave.functions import actions as A
from stepweave.functions import dates as D
from stepweave.functions import rules as R
from stepweave.functions import text as T
from stepweave.functions import urls as U
from stepweave.functions.html import to_markdown
from stepweave.functions.similarity import code_lines, indel_ratio, ssim, warped_distance


def one(spark, column, **values):
    """A column over one row of literals."""
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "want"), [("  A  b\tC\n", "a b c"), ("", ""), (" x ", "x")])
def test_normalized(spark, text, want):
    assert one(spark, T.normalized("t"), t=text) == want


@pytest.mark.parametrize(("text", "flag", "told"), [("SUCCESS: TRUE\nEXPLANATION: ok", True, "ok"), ("success: false", False, None), ("nothing", None, None), ("EXPLANATION: a\nCERTAINTY: 9", None, "a\nCERTAINTY: 9")])
def test_verdict_lines(spark, text, flag, told):
    assert one(spark, T.verdict_flag("t"), t=text) is flag
    assert one(spark, T.verdict_text("t"), t=text) == told


def test_fallback_chains_keep_their_two_readings(spark):
    assert one(spark, T.first_filled("a", "b"), a="", b="B") == "B"
    assert one(spark, F.coalesce("a", "b"), a="", b="A") == ""


@pytest.mark.parametrize(("method", "ref", "value", "want"), [("eq", 3, 3, True), ("range.te", [0, 2], 0, False), ("range.te", [0, 2], 2, True), ("approx:0.1", 1.0, "1.05", True), ("approx:0.1", 1.0, "x", False), ("re.I", "^AB", "abc", True), ("str_set_eq", ["b", "a"], "a,b", True), ("str_list_eq", ["b", "a"], "a,b", False), ("eq", 3, None, False)])
def test_rules(spark, method, ref, value, want):
    column = F.lit(value) if value is not None else F.lit(None).cast("int")
    assert one(spark, R.rule(column, method, ref)) is want


def test_spreadsheet_ranges(spark):
    assert one(spark, R.rule("v", "spreadsheet_range", ["B2:C3", "A1:D9"]), v="B2:C5") is True
    assert one(spark, R.rule("v", "spreadsheet_range", ["B2:C3", "A1:D9"]), v="B2:Z5") is False


def test_exclude_turns_each_key_around(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert df.where(R.config_filter({"a": [1], "b": [9]}, exclude=True)).count() == 0
    assert df.where(R.config_filter({"a": [5], "b": [9]}, exclude=True)).count() == 1


@pytest.mark.parametrize(("metrics", "both", "either"), [([1.0, 0.5], 0.75, 1.0), ([1.0, 0.0], 0.0, 1.0), ([0.2, 0.6], 0.4, 0.6), ([0.0, 1.0], 0.0, 1.0), ([None, 0.5], 0.0, 0.5)])
def test_conjunction(spark, metrics, both, either):
    df = spark.createDataFrame([(m,) for m in metrics], "m double")
    found = df.agg(R.conjunction("m", "and").alias("a"), R.conjunction("m", "or").alias("o")).first()
    assert (found.a, found.o) == (pytest.approx(both), pytest.approx(either))


def test_one_way_lists_hide_repeats(spark):
    arrays = {"a": F.array(F.lit("a"), F.lit("a")), "b": F.array(F.lit("a"), F.lit("b"))}
    df = spark.range(1).select(*[c.alias(k) for k, c in arrays.items()])
    assert df.select(R.list_equal_one_way("a", "b").alias("x")).first().x is True
    assert df.select(R.list_equal_one_way("b", "a").alias("x")).first().x is False


def test_rescaled(spark):
    assert one(spark, R.rescaled(F.lit(0.505), 0.5)) == 0
    assert one(spark, R.rescaled(F.lit(0.6), 0.5)) == pytest.approx(0.2)


def test_urls(spark):
    assert one(spark, U.equal_urls("a", "b"), a="www.site.com/", b="http://site.co.uk") is True
    assert one(spark, U.equal_urls("a", "b"), a="http://site.com/x", b="http://site.com/y") is False
    assert one(spark, U.equal_urls(F.lit(None).cast("string"), F.lit(None).cast("string"))) is True
    assert one(spark, U.parameter("u", "q"), u="http://a.b/?x=1&q=a%20b#f") == "a b"
    assert one(spark, U.path_part("u", 3), u="https://h/one?x=/two") == "one"
    assert one(spark, U.path_pairs("u", 4, 5), u="https://h/s/k1,k2/v1,v2") == {"k1": "v1", "k2": "v2"}


@pytest.mark.parametrize(
    ("today", "phrase", "want"),
    [("2024-08-15", "first monday four months later", "2024-12-02"), ("2024-04-30", "first monday eight months later", "2024-12-02"), ("2024-12-31", "5th next month", "2025-01-05"), ("2024-08-12", "next Monday", "2024-08-19"), ("2024-08-16", "next Friday", "2024-08-23"), ("2024-08-18", "next Saturday", "2024-08-24"), ("2024-08-14", "next week Sunday", "2024-08-25"), ("2024-08-15", "tomorrow", "2024-08-16"), ("2024-08-15", "some day", None)],
)
def test_relative_dates(spark, today, phrase, want):
    assert one(spark, D.relative_date(F.lit(today).cast("date"), phrase)) == (want and dt.date.fromisoformat(want))


def test_date_format_takes_the_first_of_each(spark):
    assert one(spark, D.formatted("{Year}-{Month0D}-{Day0D} {Year} {month}", F.lit("2024-02-03").cast("date"))) == "2024-02-03 {Year} february"


@pytest.mark.parametrize(
    ("code", "want"),
    [
        ("pyautogui.click(640, 400)", {"action": "left_click", "coordinate": [640, 360]}),
        ("pyautogui.click(10, 45, clicks=2)", {"action": "double_click", "coordinate": [10, 40]}),
        ("pyautogui.moveTo(0, 0)\npyautogui.dragRel(100, 50)", {"action": "left_click_drag", "start_coordinate": [0, 0], "coordinate": [100, 45]}),
        ("pyautogui.scroll(-3)", {"action": "scroll", "scroll_direction": "down", "scroll_amount": 3, "coordinate": [640, 360]}),
        ("pyautogui.keyDown('ctrl'); pyautogui.press('s'); pyautogui.keyUp('ctrl')", {"action": "key", "text": "ctrl+s"}),
        ("pyautogui.press('h'); pyautogui.press('i')", {"action": "type", "text": "hi"}),
        ("import pyperclip\npyperclip.copy('x y')\npyautogui.hotkey('ctrl', 'v')", {"action": "type", "text": "x y"}),
        ("WAIT", {"action": "wait", "duration": 1.0}),
        ("DONE", None),
        ("", None),
        (None, None),
        ("__import__('os').system('x')", None),
    ],
)
def test_action_codes(code, want):
    found = A.parse_action(code)
    assert (found and {k: v for k, v in found.items() if v is not None}) == want


def test_human_codes_are_never_evaluated():
    assert A.parse_human_action("pyautogui.click(x=__import__('os').getpid(), y=1)") is None
    assert A.parse_human_action("pyautogui.moveTo(x=0.5, y=0.5)")["coordinate"] == [640, 360]


@pytest.mark.parametrize(("x", "y", "want"), [(1280, 720, (999, 999)), (-5, 10, (0, 14))])
def test_grid(spark, x, y, want):
    assert (one(spark, A.scale_axis(F.lit(x), 1280)), one(spark, A.scale_axis(F.lit(y), 720))) == want


def test_tool_calls(spark):
    rows = spark.createDataFrame([("pyautogui.click(640, 400)",), ("DONE",)], "code string").withColumn("a", A.typed_action("code"))
    calls = [r.c for r in rows.select(A.tool_call("a", F.col("code") == "DONE", F.lit("fail")).alias("c")).collect()]
    assert calls == ['{"name":"computer_use","arguments":{"action":"left_click","coordinate":[500,500]}}', '{"name":"computer_use","arguments":{"action":"terminate","status":"failure"}}']


def test_ratios_and_images():
    import numpy as np

    assert indel_ratio("abcd", "abxd") == pytest.approx(75.0)
    assert indel_ratio("", "") == 100
    x = np.arange(100).reshape(10, 10)
    assert ssim(x, x) == pytest.approx(1.0) and ssim(x, x[:5]) == 0
    assert warped_distance(np.array([1.0, 2, 3]), np.array([1.0, 1, 2, 3])) == 0
    assert code_lines("#!/bin/sh\n# coding: x\n\tx  \n\ny") == ["    x", "y"]


def test_markdown():
    assert to_markdown("<html><head><title>T</title><style>x</style></head><body><h2>A</h2><p>b &amp; c</p><script>1</script></body></html>") == "# T\n\n## A\n\nb & c"


def test_cells(spark):
    assert one(spark, T.cell_column("c"), c="AB12") == 27
    assert one(spark, T.typed_cell("c"), c="=A1").kind == "formula"
    assert one(spark, T.number_format("c", 2), c="percentage") == "0.00%"


def test_last_value_of(spark):
    assert one(spark, T.last_value_of("t", "qt-bgcone", "1"), t="qt-bgcone=1\nx=2\nqt-bgcone=0") == "0"
    assert one(spark, T.last_value_of("t", "other", "1"), t="x=2") == "1"


def test_browser_settings(spark):
    import json

    from stepweave.functions import preferences as B

    mark = lambda t, n, **k: {"type": t, "name": n, **k}
    full = {"default_search_provider_data": {"template_url_data": {"short_name": "Other"}}, "browser": {"enabled_labs_experiments": ["a@1"]}, "profile": {"name": "P", "default_content_setting_values": {"cookies": 4}}, "intl": {"app_locale": "fr"}, "webkit": {"webprefs": {"default_font_size": 20}}, "enable_do_not_track": True, "safebrowsing": {"enhanced": False, "enabled": True}, "session": {"restore_on_startup": 1}, "extensions": {"settings": {"x": {"path": "/p", "manifest": {"name": "N"}}}}, "roots": {"bookmark_bar": {"children": [mark("url", "n", url="u"), mark("folder", "F", children=[mark("url", "m", url="w")])]}}}
    rows = spark.createDataFrame([(1, json.dumps(full)), (2, "{}"), (3, "not json")], "k int, s string")
    got = rows.select("k", B.search_engine("s"), B.enabled_experiments("s"), B.profile_name("s"), B.language("s"), F.element_at(B.font_sizes("s"), "default_font_size"), B.do_not_track("s"), B.enhanced_safe_browsing("s"), B.safe_browsing("s"), B.new_startup_page("s"), B.data_deleted_on_exit("s"), B.extension_paths("s"), B.extension_names("s"))
    assert sorted(tuple(r) for r in got.collect()) == [
        (1, "Other", ["a@1"], "P", "fr", 20, "true", "false", "true", "false", "true", ["/p"], ["N"]),
        (2, "Google", [], None, "en-US", 16, "false", "false", "false", "true", "Google", [], []),
        (3, "Google", [], None, "en-US", 16, "false", "Google", "false", "Google", "Google", [], []),
    ]
    found = {(r.kind, r["name"], r.url, r.folder) for r in B.bookmarks(rows, "k", "s").collect()}
    assert found == {("folder", "F", None, None), ("url", "m", "w", "F"), ("url", "n", "u", None)}


def test_costs_files_and_tokens(spark):
    import hashlib

    from stepweave.functions.urls import file_name
    from stepweave.operators.messages import share_used, tokens_by, tokens_left

    rows = spark.createDataFrame([("0.5$", "0.25$"), ("1￥", "2$"), ("3", None), ("x", "1")], "a string, b string")
    assert [r[0] for r in rows.select(T.added_cost("a", "b")).collect()] == ["0.750000$", "3.000000￥", "3.000000$", "1.000000$"]
    url = "https://a.org/x/y.pdf"
    df = spark.createDataFrame([(url, "a bc d"), (None, None)], "u string, t string")
    names = [r[0] for r in df.select(file_name("u")).collect()]
    assert names == [f"a.org_y.pdf_{hashlib.blake2b(url.encode()).hexdigest()[:8]}", None]
    n = tokens_by(len)("t")
    assert [tuple(r) for r in df.select(n, tokens_left(n, 10), share_used(n, 12)).collect()] == [(6, 4, 0.5), (0, 10, 0.0)]


def test_selectors_of_trees(spark):
    from stepweave.functions.selectors import css_to_xpath, element_texts, elements, tree_score

    xml = "<desk xmlns:st='urn:s'><app name='a' class='x y'><btn st:on='true'>Save as</btn><lab>one</lab><lab>two<i/>three</lab></app><app name='b'><btn>Open</btn></app></desk>"
    rows = spark.createDataFrame([(xml,)], "x string")
    count = lambda css: rows.select(elements("x", css_to_xpath(css))).first()[0]
    assert [count(c) for c in ("btn", "app[name=a] > btn", "app[name='a'] lab", "desk > btn", "lab + lab", "btn ~ lab", ".y", "[st|on='true']", "app[name^=b], lab", "lab:nth-child(2)", "app:first-child btn", "app:not([name=a])", "*")] == [2, 1, 2, 0, 1, 2, 1, 1, 3, 1, 1, 1, 8]
    assert rows.select(element_texts("x", "//lab")).first()[0] == ["one", "two"]
    score = lambda *rules: rows.select(tree_score("x", list(rules))).first()[0]
    assert score({"xpath": "//btn[@st:on='true']", "text": "Save as", "exact": True}, {"selectors": ["lab", "zzz"]}) == 1
    assert score({"selectors": ["app[name=b] btn"], "text": "Save as"}) == 0 == score({"xpath": "//none"})
    assert score({"selectors": ["btn"], "text": "Save at", "exact": False}) == pytest.approx(2 * 6 / 14)
    with pytest.raises(ValueError):
        css_to_xpath("a:hover")
