import pytest
from pyspark.sql import functions as F

from stepweave.functions import responses as P
from stepweave.operators import checks
from stepweave.operators import metrics as M


def value(df):
    return df.first().score


def lines(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "at int, line string")


def paragraphs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "idx int, text string")


def test_every_check_is_named():
    assert len(checks.REGISTRY) > 120


def test_csv_lines(spark):
    a = lines(spark, "x,1", "y,2")
    assert value(M.compare_csv(a, [lines(spark, "z"), lines(spark, "x,1", "y,2")])) == 1
    assert value(M.compare_csv(a, [lines(spark, "X,1", " y,2", "")])) == 0
    assert value(M.compare_csv(a, [lines(spark, "X,1", " y,2", "")], strict=False, ignore_case=True)) == 1


def test_tables_by_rules(spark):
    cells = lambda *rows: spark.createDataFrame(list(rows), "row int, col int, value string")
    a, b = cells((0, 0, "1.00001"), (0, 1, "a b")), cells((0, 0, "1"), (0, 1, "a b"))
    rules = [{"type": "sheet_name"}, {"type": "sheet_data", "sheet": "S"}, {"type": "check_cell", "sheet": "S", "row": 0, "col": 1, "method": "re", "ref": "^a"}]
    assert value(M.compare_table({"S": a}, {"S": b}, rules)) == 1
    assert value(M.compare_table({"S": a}, {"S": b.limit(1)}, rules)) == 0
    fuzzy = [{"type": "sheet_fuzzy", "sheet": "S", "rules": [{"rows": (0, 0), "cols": (1, 1), "type": "includes", "lower": True}]}]
    assert value(M.compare_table({"S": a}, {"S": cells((0, 1, "A"))}, fuzzy)) == 1


def test_documents(spark):
    a = paragraphs(spark, "one", "two")
    assert value(M.compare_init_lines(a, paragraphs(spark, "one"))) == 1
    assert value(M.compare_docx_files_fuzzy(a, paragraphs(spark, "one", "twx"))) == pytest.approx((1 + 2 / 3) / 2)
    assert value(M.fuzzy_place_math(paragraphs(spark, "Rome Oslo Bonn"), ["Rome", "Oslo", "Bonn"])) == 1
    assert value(M.fuzzy_place_math(paragraphs(spark, "Rome Oslo"), ["Rome"])) == 0
    assert value(M.compare_references(paragraphs(spark, "x", "References", "aa", "bb"), paragraphs(spark, "References", "aa", "bb"), "References", 0.5)) == 1
    spaced = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 1.5), (3, 9.0)], "idx int, spacing double")
    assert value(M.evaluate_spacing(spaced)) == 1


def test_train_records(spark):
    line = lambda *ids: lines(spark, *[f" a, {i}, b, c " for i in ids], "", "title")
    assert value(M.compare_unique_train_records(line(1, 2), line(1, 1, 2), line(2, 1))) == 1
    assert value(M.compare_unique_train_records(line(1, 1), line(1, 1, 2), line(1, 2))) == 0
    assert value(M.compare_unique_train_records(line(1, 3), line(1, 2), line(1, 3))) == 0
    assert value(M.compare_unique_train_records(line(1, 2), line(1, 2), lines(spark, "a,1,b,c", "a,2,b,c"))) == 0
    assert value(M.compare_unique_train_records(lines(spark, "a,1,b,c", "short,1"), lines(spark, "a,1,b,c", "short,1"), lines(spark, "a,1,b,c", "x"))) == 1


def test_times_of_day(spark):
    rows = lines(spark, "12:34", "99:99:99", "at 23:59:60 sharp", "24:00:00", "00:00:00")
    assert value(M.check_line_number(rows, 2)) == 1 and value(M.check_line_number(rows, 3)) == 0


def test_tab_stops(spark):
    kind = "idx int, text string, stops array<struct<position: double, alignment: string>>"
    page = lambda *rows: spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(rows)], kind)
    a = page(("one two\tthree", [(10.0, "left"), (0.0, "left"), (5.0, "clear")]), (" ", None), ("x y\tz", None))
    assert value(M.check_tabstops(a, page(("t", [(20.0, "left")]), ("u", [])), 100.0)) == pytest.approx(0.95)
    assert value(M.check_tabstops(a, page(("t", [(20.0, "right")]), ("u", [])), 100.0)) == 0
    assert value(M.check_tabstops(a, page(("t", [(20.0, "left")])), 100.0)) == 0
    assert value(M.check_tabstops(a, page(("t", [(310.0, "left")]), ("u", [])), 100.0)) == pytest.approx(-0.5)
    same = page(("t", [(10.0, "left")]), ("u", []))
    assert value(M.check_tabstops(a, same, 100.0, words=2)) == 1 and value(M.check_tabstops(a, same, 100.0, words=1)) == 0
    assert value(M.check_tabstops(a, same, 100.0, words=1, index=1)) == 1


def test_printed_sheets_and_bookmarks(spark):
    a, b = lines(spark, "A,1", "b,2"), lines(spark, "a,1", "B,2")
    rule = {"type": "sheet_print", "sheet": "S"}
    assert value(M.compare_table({"S": a}, {"S": b}, [rule])) == 0 and value(M.compare_table({"S": a}, {"S": b}, [{**rule, "ignore_case": True}])) == 1
    marks = spark.createDataFrame([("folder", "Liked Authors", None, None), ("url", "x", "u1", "Liked Authors"), ("url", "y", "u3", "Liked Authors"), ("url", "z", "u9", None)], "kind string, name string, url string, folder string")
    assert value(M.is_expected_bookmarks(marks, "liked_authors", [["u1", "u2"], "u3"])) == 1
    assert value(M.is_expected_bookmarks(marks, "liked_authors", [["u2", "u4"], "u3"])) == 0
    assert value(M.is_expected_bookmarks(marks, "liked_authors", [["u1", "u3"], ["u1", "u3"], "u3"])) == 1
    assert value(M.is_expected_bookmarks(marks.where("kind = 'url'"), "liked_authors", ["u1", "u3"])) == 0
    assert value(M.is_expected_bookmarks(marks, "url", ["u9"])) == 1 and value(M.is_expected_bookmarks(marks, "folder", ["Liked Authors"])) == 1


def test_structure_of_images(spark):
    def image(f, w=12, h=10):
        return spark.createDataFrame([("i", x, y, *f(x, y), 255) for x in range(w) for y in range(h)], "img string, x int, y int, r int, g int, b int, a int")

    base = image(lambda x, y: ((x * 37 + y * 11) % 200, (x * 13) % 180, (y * 29) % 160))
    dark = base.select("img", "x", "y", *[F.floor(F.col(c) / 2).cast("int").alias(c) for c in "rgb"], "a")
    other = image(lambda x, y: ((x * 91 + y * 57) % 251, (y * 77) % 199, (x * 43) % 233))
    assert value(M.check_structure_sim(base, base)) == 1 and value(M.check_structure_sim(base, other)) == 0
    assert value(M.check_structure_sim(base, image(lambda x, y: (0, 0, 0), 13))) == 0
    assert value(M.check_brightness_decrease_and_structure_sim(dark, base)) == 1 and value(M.check_brightness_decrease_and_structure_sim(base, dark)) == 0
    twice = image(lambda x, y: ((x // 2 * 37 + y // 2 * 11) % 200, (x // 2 * 13) % 180, (y // 2 * 29) % 160), 24, 20)
    assert value(M.check_structure_sim_resized(twice, base, 12, 10)) == 1
    assert value(M.check_palette_and_structure_sim(base, base, True)) == 1 and value(M.check_palette_and_structure_sim(base, base, False)) == 0
    gray = base.withColumn("g", F.col("r")).withColumn("b", F.col("r"))
    assert value(M.check_saturation_increase_and_structure_sim(gray, base)) == 0
    assert value(M.check_contrast_increase_and_structure_sim(dark, base)) == 0
    assert value(M.compare_triangle_positions(base, base)) == 1


def test_slides(spark):
    run = "slide int, shape int, paragraph int, run int, text string, bold boolean, left double"
    a = spark.createDataFrame([(0, 0, 0, 0, "t", None, 100.0)], run)
    b = spark.createDataFrame([(0, 0, 0, 0, "t", False, 100.2)], run)
    assert value(M.compare_pptx_files(a, b, ("text", "bold", "left"))) == 1
    assert value(M.compare_pptx_files(a, b.withColumn("left", F.lit(110.0)), ("text", "bold", "left"))) == 0
    shapes = spark.createDataFrame([(0, 0, "x", 0, 0, 0), (0, 1, "3", 255, 0, 0)], "slide int, idx int, text string, r int, g int, b int")
    assert value(M.check_slide_numbers_color(shapes)) == 1
    assert value(M.check_slide_numbers_color(shapes.limit(1))) == 0


def test_images(spark):
    image = lambda f: spark.createDataFrame([("i", x, y, *f(x, y), 255) for x in range(6) for y in range(6)], "img string, x int, y int, r int, g int, b int, a int")
    flat, dark, edge = image(lambda x, y: (200, 100, 100)), image(lambda x, y: (50, 50, 50)), image(lambda x, y: (255 * (x % 2),) * 3)
    assert value(M.decrease_brightness(flat, dark)) == 1 and value(M.increase_saturation(dark, flat)) == 1
    assert value(M.check_sharper(edge, flat)) == 1
    assert value(M.structure_check_by_mse(flat, flat)) == 1 and value(M.structure_check_by_mse(flat, edge)) == 0
    slope = image(lambda x, y: (x * 40, 0, 0))
    assert value(M.check_image_mirror(slope, slope.withColumn("x", 5 - F.col("x")), 6)) == 1
    assert value(M.check_image_mirror(slope, slope, 6)) == 0
    assert value(M.check_image_size(flat, 6, 6)) == 1


def test_archives_and_pages(spark):
    files = lambda *rows: spark.createDataFrame(list(rows), "name string, hash string, text string")
    a = files(("x", "1", "a"), ("y", "2", "b"))
    assert value(M.compare_archive(a, files(("x", "1", "a"), ("y", "3", "c")))) == 0.5
    assert value(M.compare_archive(a, a.limit(1))) == 0
    cookies = spark.createDataFrame([("www.shop.com",)], "domain string")
    assert value(M.is_cookie_deleted(cookies, ["shop.org"])) == 0 and value(M.is_cookie_deleted(cookies, ["other.org"])) == 1


def test_settings(spark):
    prefs = lines(spark, 'user_pref("a.b", true);', 'user_pref("a.b", false);', 'user_pref("n", 5);', "// x")
    assert value(M.check_thunderbird_prefs(prefs, {"a.b": {"method": "eq", "ref": False}, "n": {"method": "ge", "ref": 5}})) == 1
    assert value(M.check_thunderbird_prefs(prefs, {"n": {"method": "eq", "ref": 5}}, {"a.b": {"method": "eq", "ref": False}})) == 0
    rc = lines(spark, "# (theme x)", '(theme "Dark")')
    assert value(M.check_config_status(rc, ["theme"], '"Dark"')) == 1
    mail = lines(spark, 'name="f"', 'enabled="yes"', 'action="Move"', 'condition="AND (subject,contains,a b)"', 'name="open"')
    assert value(M.check_thunderbird_filter(mail, [{"name": "f", "condition": ["AND (subject,contains,a b)"]}])) == 1
    assert value(M.check_thunderbird_filter(mail, [{"name": "open"}])) == 0


def test_mailboxes_skip_empty_and_deleted_messages(spark):
    a = "FROM - x\nX-Mozilla-Status: 0001\nhi\nFROM - y\nX-Mozilla-Status: 0009\ngone\n"
    df = spark.createDataFrame([(a, "FROM - x\nX-Mozilla-Status: 0000\nhi\n", "FROM - z\n")], "a string, b string, c string")
    same = checks.REGISTRY["check_thunderbird_folder"]
    assert df.select(same("a", "b", ignore_status=True), same("a", "b"), same("a", "c")).first() == (1.0, 0.0, 0.0)


def test_json_rules(spark):
    df = spark.createDataFrame([('{"a": {"b": [1, "smart thing"]}, "n": 3}',)], "j string")
    assert value(M.check_json(df, "j", [{"key": ["a", "b", 1], "method": "re", "ref": r"\bsmart\b"}, {"key": ["n"], "method": "eq", "ref": 3}], [{"key": ["zz"], "method": "eq", "ref": 1}])) == 1
    assert value(M.check_json(df, "j", [{"key": ["zz"], "method": "eq", "ref": 1}])) == 0


def test_tool_responses():
    text = 'Action: Click Save\n<tool_call>\n{"name": "computer_use", "arguments": {"action": "left_click", "coordinate": [999, 500]}}\n</tool_call>'
    assert P.parse_tool_response(text, (1920, 1080)) == ("Click Save", ["pyautogui.click(1920, 540)"])
    assert P.parse_tool_response('{"name": "computer_use", "arguments": {"action": "key", "keys": ["ctrl", "c"]}}') == ("Performing hotkey action", ["pyautogui.hotkey('ctrl', 'c')"])
    assert P.parse_tool_response("<tool_call>\nnot json\n</tool_call>") == ("", []) == P.parse_tool_response(None)


def test_tuned_responses_say_where_a_drag_starts():
    call = '{"name": "computer_use", "arguments": {"action": "left_click_drag", "start_coordinate": [0, 0], "coordinate": [999, 999]}}'
    text = f"Reasoning: move it\n<tool_call>\n{call}\n</tool_call>"
    assert P.parse_tool_response(text, (1920, 1080), tuned=True) == ("move it", ["pyautogui.moveTo(0, 0)", "pyautogui.dragTo(1920, 1080, duration=0.5)"])
    assert P.parse_tool_response(text, (1920, 1080))[1] == ["pyautogui.dragTo(1920, 1080, duration=0.5)"]
    assert P.parse_tool_response('{"name": "computer_use", "arguments": {"action": "left_click_drag"}}', tuned=True)[1] == ["pyautogui.dragTo(0, 0)"]


def test_thoughts():
    found = P.parse_thought("Thought: look\nAction: click(start_box='(500,250)')")
    assert found == [{"reflection": None, "thought": "look", "action_type": "click", "action_inputs": {"start_box": "[0.5, 0.25, 0.5, 0.25]"}}]
    assert P.parse_thought("no action") == []


def test_other_responses(spark):
    assert P.parse_json_actions('```json\n{"a": 1}\n```') == ['{"a": 1}'] and P.parse_json_actions("DONE") == ["DONE"] and P.parse_json_actions("x") == []
    assert P.parse_dag('<json>{"dag": {"nodes": [1], "edges": []}}</json>') == {"nodes": [1], "edges": []}
    assert P.fix_less_than("pyautogui.typewrite('a<b')") == "pyautogui.typewrite('a'); pyautogui.hotkey(\"shift\", \",\"); pyautogui.typewrite('b')"
    df = spark.createDataFrame([("```python\nx = 1\nDONE\n```", '[{"reasoning": " r ", "action": "a"}, {"reasoning": "", "action": "b"}]', '{"tasks": [{"description": "d"}, "e", {}]}')], "code string, cand string, tasks string")
    row = df.select(P.code_actions("code").alias("c"), P.candidates("cand").alias("k"), P.proposals("tasks").alias("t"), P.match_flag("cand").alias("m")).first()
    assert row.c == ["x = 1", "DONE"] and [tuple(k) for k in row.k] == [("r", "a")] and row.t == ["d", "e"] and row.m is False


def test_strike_through_of_each_last_paragraph(spark):
    runs = lambda *rows: spark.createDataFrame(list(rows), "doc string, p int, r int, strike boolean")
    struck = [("a", 1, 0, False), ("a", 2, 0, True), ("a", 2, 1, True), (None, 1, 0, True), ("b", None, 0, False)]
    assert value(M.evaluate_strike_through_last_paragraph(runs(*struck))) == 1
    assert value(M.evaluate_strike_through_last_paragraph(runs(*struck, ("a", 2, 2, None)))) == 0
    assert value(M.evaluate_strike_through_last_paragraph(runs(*struck, ("c", 1, 0, False), ("c", 1, 1, True)))) == 0
