"""Scoring metrics over the test tables, one query for each metric: by row, or a few cases of a metric that gives one score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave.operators import metrics as M
from stepweave.operators.checks import REGISTRY
from stepweave.plans.registry import register
from stepweave.session import table

# metrics of a row: name, table, key, score of a row (given when the session runs), the same as SQL


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _odd(key: str, yes: str, no: str) -> Column:
    return F.when(F.col(key) % 2 == 1, yes).otherwise(no)


def _setting(name: str, want, **options):
    """A settings file whose last value of a key is event_id % 3."""
    return lambda: REGISTRY[name](_text(f"#{options['key']}=9\n{options['key']}=7\n{options['key']}=", F.col("event_id") % 3, "\nother=1\n"), want)


def _xml(path: list[str], name: str, value: Column) -> Column:
    return _text(f'<items xmlns:oor="urn:x"><item oor:path="{path}"><prop oor:name="{name}"><value>', value, "</value></prop></item></items>")


ROWS = [
    ("match_in_list", "part", "p_partkey", lambda: REGISTRY["match_in_list"]("p_brand", ["Brand#13", "Brand#22"]), "p_brand in ('Brand#13', 'Brand#22')"),
    ("is_in_list", "part", "p_partkey", lambda: REGISTRY["is_in_list"](F.split("p_name", " "), "widget"), "list_contains(string_split(p_name, ' '), 'widget')"),
    ("file_contains", "documents", "doc_id", lambda: REGISTRY["file_contains"]("text", ["the", "an"]), "contains(text, 'the') and contains(text, 'an')"),
    ("gold_text_included", "documents", "doc_id", lambda: REGISTRY["is_gold_text_included_in_pdf"]("text", ["en ", "er "]), "contains(text, 'en ') and contains(text, 'er ')"),
    ("steam_cart", "part", "p_partkey", lambda: REGISTRY["is_added_to_steam_cart"]("p_name", ["cold", "widget"]), "contains(p_name, 'cold') and contains(p_name, 'widget')"),
    ("clipboard", "part", "p_partkey", lambda: REGISTRY["is_in_vm_clipboard"]("p_type", "CO"), "contains(p_type, 'CO')"),
    ("compare_config", "orders", "o_orderkey", lambda: REGISTRY["compare_config"]("o_orderstatus", F.lit("F")), "o_orderstatus = 'F'"),
    ("compare_answer", "customer", "c_custkey", lambda: REGISTRY["compare_answer"]("c_mktsegment", F.lit("BUILDING")), "c_mktsegment = 'BUILDING'"),
    ("terminal_and_txt", "pages", "page_id", lambda: REGISTRY["compare_terminal_and_txt"]("url", F.regexp_replace("url", r"\?.*$", "")), r"url = regexp_replace(url, '\?.*$', '') and url <> ''"),
    ("extension_installed", "part", "p_partkey", lambda: REGISTRY["is_extension_installed"]("p_name", "not_contain", "widget"), "not contains(p_name, 'widget')"),
    ("search_query", "pages", "page_id", lambda: REGISTRY["is_expected_search_query"]("url", "utm_source=[a-z]+"), "regexp_matches(url, 'utm_source=[a-z]+')"),
    ("font_size_value", "part", "p_partkey", lambda: REGISTRY["check_font_size"]("p_size", "value", 24), "p_size = 24"),
    ("font_size_range", "part", "p_partkey", lambda: REGISTRY["check_font_size"]("p_size", "range", 10, 30), "p_size > 10 and p_size < 30"),
    ("utc_0", "events", "event_id", lambda: REGISTRY["is_utc_0"](_text("a\nb\nc\nTime zone: UTC (UTC, ", _odd("event_id", "+0000)", "+0100)"), "\nd")), "event_id % 2 = 1"),
    ("moved_jpgs", "part", "p_partkey", lambda: REGISTRY["check_moved_jpgs"](F.split("p_name", " "), F.reverse(F.split("p_name", " "))), "len(string_split(p_name, ' ')) > 0"),
    ("qt_bgcone", "events", "event_id", _setting("check_qt_bgcone", 1, key="qt-bgcone"), "event_id % 3 = 1"),
    ("qt_max_volume", "events", "event_id", _setting("check_qt_max_volume", 2, key="qt-max-volume"), "event_id % 3 = 2"),
    ("qt_minimal_view", "events", "event_id", _setting("check_qt_minimal_view", 0, key="qt-minimal-view"), "event_id % 3 = 0"),
    ("one_instance", "events", "event_id", _setting("check_one_instance_when_started_from_file", 1, key="one-instance-when-started-from-file"), "event_id % 3 = 1"),
    ("global_key", "events", "event_id", lambda: REGISTRY["check_global_key_play_pause"](_text("global-key-play-pause=", _odd("event_id", "F2", ""), "\n"), 1), "event_id % 2 = 1"),
    ("recordings_folder", "events", "event_id", lambda: REGISTRY["is_vlc_recordings_folder"](_text("x=1\ninput-record-path=/home/", F.col("event_id") % 4, "\n"), "/home/2"), "event_id % 4 = 2"),
    ("background_image", "pages", "page_id", lambda: REGISTRY["check_html_background_image"](_text("<style>body {background-image: url('", F.col("page_id") % 3, ".png');}</style>"), "1.png"), "page_id % 3 = 1"),
    ("presenter_console", "events", "event_id", lambda: REGISTRY["check_presenter_console_disable"](_xml("/p", "EnablePresenterScreen", _odd("event_id", "false", "true"))), "event_id % 2 = 1"),
    ("default_font", "events", "event_id", lambda: REGISTRY["find_default_font"](_xml("/p", "Standard", _odd("event_id", "Serif", "Sans")), "Sans"), "event_id % 2 = 0"),
    ("auto_save", "events", "event_id", lambda: REGISTRY["check_auto_saving_time"](_xml("/p", "AutoSaveTimeIntervall", F.col("event_id") % 5), 3), "event_id % 5 = 3"),
    ("left_panel", "events", "event_id", lambda: REGISTRY["check_left_panel"](_text("<a><document-frame name='", _odd("event_id", "Slides View", "Notes"), "'/></a>")), "event_id % 2 = 1"),
    ("transition", "events", "event_id", lambda: REGISTRY["check_transition"](_text("<s><transition><", _odd("event_id", "dissolve", "wipe"), "/></transition></s>"), "dissolve"), "event_id % 2 = 1"),
    ("accessibility_xml", "events", "event_id", lambda: REGISTRY["check_accessibility_xml"](_text("<d xmlns:st='urn:s'><a><b st:on='", _odd("event_id", "true", "false"), "'>", F.col("event_type"), "</b></a></d>"), [{"selectors": ["a > b[st|on=true]"], "text": "error"}]), "event_id % 2 = 1 and event_type = 'error'"),
    ("pdf_pages", "part", "p_partkey", lambda: REGISTRY["check_pdf_pages"]("p_size", "ge", 20), "p_size >= 20"),
    ("vlc_playing", "events", "event_id", lambda: REGISTRY["is_vlc_playing"](_odd("event_id", "playing", "paused"), F.concat(F.lit("/home/"), "event_type"), "error"), "event_id % 2 = 1 and event_type like '%error'"),
    ("speedtest_times", "events", "event_id", lambda: REGISTRY["compare_time_in_speedtest_results"]("ts", F.date_trunc("hour", "ts"), 30), "floor(epoch(ts)) - epoch(date_trunc('hour', ts)) <= 1800"),
    ("conversion", "part", "p_partkey", lambda: REGISTRY["evaluate_conversion"](F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(F.col("p_name"))), "not (p_size % 2 = 0 and upper(p_type) = p_type)"),
    ("extensions_subset", "part", "p_partkey", lambda: REGISTRY["is_expected_installed_extensions"](F.array(F.lit("cold")), F.split("p_name", " ")), "list_contains(string_split(p_name, ' '), 'cold')"),
    ("favorite_apps", "part", "p_partkey", lambda: REGISTRY["check_gnome_favorite_apps"](F.split("p_name", " "), F.array(F.lit("widget"), F.lit("cold"))), "list_sort(string_split(p_name, ' ')) = ['cold', 'widget']"),
    ("portrait", "lineitem", "l_orderkey, l_linenumber", lambda: REGISTRY["check_slide_orientation_portrait"]("l_quantity", F.lit(20)), "l_quantity < 20"),
    ("fullscreen", "lineitem", "l_orderkey, l_linenumber", lambda: REGISTRY["is_vlc_fullscreen"](F.struct("l_linenumber", F.lit(1).alias("h")), F.struct(F.lit(3).alias("l_linenumber"), F.lit(1).alias("h"))), "l_linenumber = 3"),
    ("locale_globs", "part", "p_partkey", lambda: REGISTRY["check_libre_locale"](F.when(F.col("p_size") % 2 == 0, F.col("p_type")), "p_name", ["ECO*", "* w?dget"]), "case when p_size % 2 = 0 then p_type else p_name end like 'ECO%' or case when p_size % 2 = 0 then p_type else p_name end like '% w_dget'"),
    ("experiments", "part", "p_partkey", lambda: REGISTRY["check_enabled_experiments"](F.transform(F.split("p_name", " "), lambda x: F.concat(x, F.lit("@1"))), ["cold", "widget"]), "p_name = 'cold widget'"),
    ("result_files", "part", "p_partkey", lambda: REGISTRY["compare_result_files"](F.col("p_size").cast("string"), F.lit("24")), "contains(cast(p_size as varchar), '24')"),
    ("slider_colours", "part", "p_partkey", lambda: REGISTRY["check_qt_slider_colours"](_text("1;2;", F.col("p_size") * 4)), "p_size * 4 < 100"),
    ("image_file_size", "documents", "doc_id", lambda: REGISTRY["check_image_file_size"]("text", 1000), "octet_length(encode(text)) < 1000"),
    ("red", "lineitem", "l_orderkey, l_linenumber", lambda: REGISTRY["is_red_color"](F.lit(255), F.col("l_linenumber") - 1, F.lit(0)), "l_linenumber = 1"),
    ("json_settings", "part", "p_partkey", lambda: REGISTRY["check_json_settings"](F.create_map(F.lit("a"), F.col("p_brand"), F.lit("b"), F.lit("x")), F.create_map(F.lit("a"), F.lit("Brand#13"))), "p_brand = 'Brand#13'"),
    ("keybindings", "part", "p_partkey", lambda: REGISTRY["check_json_keybindings"](_text('// head\n[{"key": "', F.col("p_size") % 3, '", "command": "go"}]'), F.create_map(F.lit("key"), F.lit("1"), F.lit("command"), F.lit("go"))), "p_size % 3 = 1"),
    ("time_lines", "events", "event_id", lambda: REGISTRY["exact_match"](F.size(F.filter(F.split(_text("12:34\n", F.date_format("ts", "HH:mm:ss"), "\n99:99:99"), "\n"), lambda x: x.rlike(M.TIME_OF_DAY))), F.lit(1)), "ts is not null"),
]


def _add_row(name: str, source: str, key: str, made, condition: str) -> None:
    @register(f"metric_{name}", f"select {key}, case when coalesce({condition}, false) then 1.0 else 0.0 end::double as score from {source}")
    def run(spark, sf_dir):
        return table(spark, sf_dir, source).select(*key.split(", "), made().alias("score"))


for _row in ROWS:
    _add_row(*_row)


# metrics that give one score: a few cases each, by name


def _cases(**scores: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("name"), F.col("score").cast("double").alias("score")) for name, df in scores.items()])


def _case_sql(**scores: str) -> str:
    return " union all ".join(f"select '{name}' as name, cast(({sql}) as double) as score" for name, sql in scores.items())


def _when(condition: str, source: str) -> str:
    """SQL: 1 if an aggregate condition holds over a source."""
    return f"select case when coalesce({condition}, false) then 1.0 else 0.0 end from {source}"


@register("metric_csv", _case_sql(strict=_when("bool_and(a.p_name = b.p_name)", "part a join part b using (p_partkey)"), upper=_when("bool_and(a.p_name = upper(b.p_name))", "part a join part b using (p_partkey)"), either=_when("bool_and(lower(a.p_name) = lower(upper(b.p_name)))", "part a join part b using (p_partkey)"), short=_when("bool_and(b.p_partkey is not null)", "part a left join (select * from part where p_partkey > 3) b using (p_partkey)")))
def metric_csv(spark, sf_dir):
    a = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("at"), F.col("p_name").alias("line"))
    upper = a.withColumn("line", F.upper("line"))
    return _cases(strict=M.compare_csv(a, [upper, a]), upper=M.compare_csv(a, [upper]), either=M.compare_csv(a, [upper], strict=False, ignore_case=True), short=M.compare_csv(a, [a.where("at > 3")]))


def _cells(spark, sf_dir, value: Column) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row"), F.lit(0).alias("col"), value.cast("string").alias("value"))


@register("metric_cells", _case_sql(near=_when("bool_and(round(p_retailprice, 4) = round(p_retailprice + 0.00001, 4))", "part"), far=_when("bool_and(round(p_retailprice, 4) = round(p_retailprice + 0.1, 4))", "part"), includes=_when("bool_and(contains(lower(p_name), lower(split_part(p_name, ' ', 1))))", "part"), included=_when("bool_and(contains(split_part(p_name, ' ', 1), p_name))", "part")))
def metric_cells(spark, sf_dir):
    price, name = _cells(spark, sf_dir, F.col("p_retailprice")), _cells(spark, sf_dir, F.col("p_name"))
    first = _cells(spark, sf_dir, F.upper(F.split_part("p_name", F.lit(" "), F.lit(1))))
    rule = {"rows": (0, 10**9), "cols": (0, 0)}
    return _cases(
        near=M.cells_agree(price, _cells(spark, sf_dir, F.col("p_retailprice") + 0.00001)), far=M.cells_agree(price, _cells(spark, sf_dir, F.col("p_retailprice") + 0.1)),
        includes=M.fuzzy_cells(name, first, [{**rule, "type": "includes", "lower": True}]), included=M.fuzzy_cells(name, first, [{**rule, "type": "included_by", "lower": True}]),
    )


def _paragraphs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("idx"), F.col("o_orderpriority").alias("text"), F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(2.0).alias("spacing"),
        F.when(F.col("o_orderstatus") == "F", "center").otherwise("left").alias("alignment"), F.when(F.col("o_orderstatus") == "P", "yellow").alias("highlight"), F.lit("doc").alias("doc"),
    )


@register(
    "metric_paragraphs",
    _case_sql(
        init_lines=_when("count(*) > 0", "orders"), init_other=_when("bool_and(o_orderpriority = o_orderstatus)", "orders"), spacing=_when("count(*) > 0", "orders"), spacing_other=_when("bool_and(o_orderstatus <> 'F')", "orders"),
        centered="select case when o_orderstatus = 'F' then 1 else 0 end from orders order by o_orderkey limit 1", footers=_when("bool_and(regexp_matches(o_orderpriority, '[0-9]'))", "orders"), highlighted=_when("not bool_or(o_orderstatus = 'P')", "orders"),
        first_spacings="select case when list(case when o_orderstatus = 'F' then 1.0 else 2.0 end order by o_orderkey)[1:3] = [1.0, 2.0, 1.5] then 1 else 0 end from orders",
    ),
)
def metric_paragraphs(spark, sf_dir):
    p = _paragraphs(spark, sf_dir)
    other = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_orderstatus").alias("text"))
    return _cases(
        init_lines=M.compare_init_lines(p, p), init_other=M.compare_init_lines(p, other), spacing=M.compare_line_spacing(p, p), spacing_other=M.compare_line_spacing(p, p.withColumn("spacing", F.lit(2.0))),
        centered=M.is_first_line_centered(p), footers=M.has_page_numbers_in_footers(p), highlighted=M.check_highlighted_words(p), first_spacings=M.evaluate_spacing(p),
    )


def _lines(spark, sf_dir, *by: str) -> DataFrame:
    """Lines of orders with their number `n` by some columns, from 0: line numbers repeat within orders. It goes by all that the metrics read, so both sides of a comparison number alike."""
    order = ["l_linenumber", "l_returnflag", "l_linestatus", "l_quantity"]
    return table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def _runs(spark, sf_dir) -> DataFrame:
    """Lines of orders as runs of paragraphs."""
    return _lines(spark, sf_dir, "l_orderkey").select(
        F.lit("doc").alias("doc"), F.col("l_orderkey").alias("p"), F.col("n").alias("r"), F.when(F.col("l_returnflag") == "R", "Mono").otherwise("Serif").alias("font"), (F.col("l_returnflag") == "A").alias("equation"),
        (F.col("l_linestatus") == "O").alias("has_image"), (F.col("l_quantity") == 50).alias("page_break"), (F.col("l_returnflag") == "R").alias("strike"), (F.col("l_linestatus") == "F").alias("italic"), F.when(F.col("l_linestatus") == "F", 14).otherwise(10).alias("size"),
    )


_ONE = "(select * from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber) = 1)"


@register(
    "metric_runs",
    _case_sql(
        fonts=_when("bool_and(l_returnflag <> 'R')", "lineitem"), equation=_when("bool_or(l_returnflag = 'A')", "lineitem"), images=_when("count(*) > 0", "lineitem"), no_images=_when("bool_and(l_linestatus = 'O')", "lineitem"), breaks=_when("bool_or(l_quantity = 50)", "lineitem"),
        italic=_when("count(*) > 0", "lineitem"), strike=_when("bool_and(l_returnflag = 'R')", "lineitem where l_orderkey = (select max(l_orderkey) from lineitem)"),
    ),
)
def metric_runs(spark, sf_dir):
    r = _runs(spark, sf_dir)
    return _cases(
        fonts=M.compare_font_names(r, "Serif"), equation=M.compare_runs(r, r, "equation"), images=M.compare_contains_image(r, r), no_images=M.compare_contains_image(r, r.withColumn("has_image", F.lit(True))), breaks=M.contains_page_break(r),
        italic=M.check_italic_font_size_14(r), strike=M.evaluate_strike_through_last_paragraph(r),
    )


@register("metric_tab_stops", "select 'near' as name, round(1 - avg(0.5 * (o_orderkey % 3) / 100.0), 9) as score from orders union all select 'aligned' as name, 0.0::double as score")
def metric_tab_stops(spark, sf_dir):
    stop = lambda at, how="left": F.array(F.struct(at.cast("double").alias("position"), F.lit(how).alias("alignment")))
    rows = table(spark, sf_dir, "orders").select(F.lit(1).alias("doc"), F.col("o_orderkey").alias("idx"), F.col("o_orderpriority").alias("text"))
    a = rows.withColumn("stops", F.concat(stop(F.lit(10)), stop(F.lit(0)), stop(F.lit(70), "clear")))
    near = M.check_tabstops(a, rows.withColumn("stops", stop(10 + 0.5 * (F.col("idx") % 3))), 100.0)
    return _cases(near=near.select(F.round("score", 9).alias("score")), aligned=M.check_tabstops(a, rows.withColumn("stops", stop(F.lit(10), "right")), 100.0))


@register("metric_train_records", _case_sql(whole=_when("count(*) = count(distinct p_partkey)", "part"), twice="select 0", foreign="select 0"))
def metric_train_records(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    lines = part.select(F.col("p_partkey").alias("at"), F.concat_ws(", ", F.lit(" n"), F.col("p_partkey").cast("string"), "p_brand", F.lit("x ")).alias("line"))
    return _cases(whole=M.compare_unique_train_records(lines, lines.union(lines), lines), twice=M.compare_unique_train_records(lines.union(lines), lines, lines), foreign=M.compare_unique_train_records(lines, lines.where("at > 2"), lines))


@register(
    "metric_slides",
    _case_sql(
        same=_when("count(*) > 0", "lineitem"), moved=_when("bool_and(l_quantity + 1 - l_quantity <= (l_quantity + 1) * 0.005)", "lineitem"), strike=_when("bool_and(l_returnflag = 'R')", f"{_ONE} where l_linenumber in (1, 2)"),
        fill="select round(1 - avg(sqrt((l_linenumber * 30 - 0) ** 2) / sqrt(3 * 255.0 ** 2)), 9) from lineitem", colored=_when("bool_and(false)", "lineitem"),
    ),
)
def metric_slides(spark, sf_dir):
    """A line number is a paragraph, its lines are the runs; of the first runs the SQL leaves the choice open."""
    rows = _lines(spark, sf_dir, "l_orderkey", "l_linenumber")
    runs = rows.select(F.col("l_orderkey").alias("slide"), F.lit(0).alias("shape"), F.col("l_linenumber").alias("paragraph"), F.col("n").alias("run"), F.col("l_returnflag").alias("text"), F.col("l_quantity").alias("left"), (F.col("l_returnflag") == "R").alias("strike"))
    slides = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") * 30).alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b"), F.lit(False).alias("unchanged"))
    first = rows.where("l_linenumber in (1, 2)").select(F.lit(0).alias("slide"), F.lit(0).alias("shape"), F.lit(0).alias("paragraph"), F.col("n").alias("run"), (F.col("l_returnflag") == "R").alias("strike"))
    return _cases(
        same=M.compare_pptx_files(runs, runs, ("text", "left")), moved=M.compare_pptx_files(runs, runs.withColumn("left", F.col("left") + 1), ("text", "left")), strike=M.check_strikethrough(first, [0], [0], [0]),
        fill=M.evaluate_presentation_fill_to_rgb_distance(slides, (0, 0, 0)).select(F.round("score", 9).alias("score")), colored=M.check_page_number_colors(slides.where("r < 0"), "red"),
    )


def _pixels(spark, sf_dir, scale: float = 1.0, mirrored: bool = False) -> DataFrame:
    """An image of 100 x 40 pixels for each remainder of the order keys."""
    cells = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 100).alias("x"), (F.col("l_orderkey") % 40).alias("y"), "l_quantity", "l_linenumber")
    one = cells.groupBy("x", "y").agg(F.max("l_quantity").alias("q"), F.max("l_linenumber").alias("n"))
    x = 99 - F.col("x") if mirrored else F.col("x")
    return one.select(F.lit("i").alias("img"), x.alias("x"), "y", F.floor(F.col("q") * 5 * scale).cast("int").alias("r"), F.floor(F.col("n") * 30 * scale).cast("int").alias("g"), F.lit(10).alias("b"), F.lit(255).alias("a"))


_PIXELS = "(select l_partkey % 100 as x, l_orderkey % 40 as y, floor(max(l_quantity) * 5) as r, floor(max(l_linenumber) * 30) as g, floor(max(l_quantity) * 5 * 0.5) as r2, floor(max(l_linenumber) * 30 * 0.5) as g2 from lineitem group by 1, 2)"


@register(
    "metric_images",
    _case_sql(
        darker=_when("avg(floor(r2 * 0.299 + g2 * 0.587 + 1.14 + 0.5)) < avg(floor(r * 0.299 + g * 0.587 + 1.14 + 0.5))", _PIXELS), brighter=_when("avg(floor(r2 * 0.299 + g2 * 0.587 + 1.14 + 0.5)) > avg(floor(r * 0.299 + g * 0.587 + 1.14 + 0.5))", _PIXELS),
        contrast=_when("stddev_pop(floor(r2 * 0.299 + g2 * 0.587 + 1.14 + 0.5)) < stddev_pop(floor(r * 0.299 + g * 0.587 + 1.14 + 0.5))", _PIXELS), mse=_when("avg((((r - r2) / 255) ** 2 + ((g - g2) / 255) ** 2) / 3) < 0.03", _PIXELS),
        same=_when("count(*) > 0", _PIXELS), halved=_when("bool_and(r = r2 and g = g2)", _PIXELS), mirror=_when("count(*) > 0", _PIXELS), size=_when("max(x) - min(x) + 1 = 100 and max(y) - min(y) + 1 = 40", _PIXELS),
    ),
)
def metric_images(spark, sf_dir):
    image, half = _pixels(spark, sf_dir), _pixels(spark, sf_dir, 0.5)
    return _cases(
        darker=M.decrease_brightness(image, half), brighter=M.decrease_brightness(half, image), contrast=M.increase_contrast(half, image), mse=M.structure_check_by_mse(image, half),
        same=M.compare_image_list(image, image), halved=M.compare_image_list(image, half), mirror=M.check_image_mirror(image, _pixels(spark, sf_dir, mirrored=True), 100), size=M.check_image_size(image, 100, 40),
    )


@register("metric_structure", _case_sql(same="select 1", existing="select 1", palette="select 0"))
def metric_structure(spark, sf_dir):
    """Structural similarity of an image to itself is 1."""
    full = spark.range(48).select(F.explode(F.sequence(F.lit(0), F.lit(39))).alias("y"), F.col("id").alias("x")).join(_pixels(spark, sf_dir).select("x", "y", "r", "g"), ["x", "y"], "left")
    image = full.select(F.lit("i").alias("img"), "x", "y", F.coalesce("r", F.lit(0)).alias("r"), F.coalesce("g", F.lit(0)).alias("g"), F.lit(10).alias("b"), F.lit(255).alias("a"))
    return _cases(same=M.check_structure_sim(image, image), existing=REGISTRY["check_file_exists_and_structure_sim"](image, image), palette=M.check_palette_and_structure_sim(image, image, False))


@register(
    "metric_files",
    _case_sql(
        archive="select avg(case when p_size = least(p_size, 30) then 1.0 else 0.0 end) from part", missing="select 0", zip=_when("bool_and(p_size <= 30)", "part"), exists=_when("bool_or(p_name = 'cold widget')", "part"), cookies=_when("not bool_or(split_part(split_part(url, '://', 2), '/', 1) = 'nowhere.example.net')", "pages"),
        history=_when("not bool_or(contains(url, 'utm_source'))", "pages"), shortcut=_when("bool_or(p_brand = 'Brand#13')", "part"), pdf_hashes="select avg(case when bit_count(xor(p_partkey, 255)) <= 5 then 1.0 else 0.0 end) from part",
    ),
)
def metric_files(spark, sf_dir):
    part, pages = table(spark, sf_dir, "part"), table(spark, sf_dir, "pages")
    files = part.select(F.col("p_partkey").cast("string").alias("name"), F.col("p_size").cast("string").alias("hash"), F.col("p_name").alias("text"))
    cut = part.select(F.col("p_partkey").cast("string").alias("name"), F.least("p_size", F.lit(30)).cast("string").alias("hash"), F.col("p_name").alias("text"))
    return _cases(
        archive=M.compare_archive(files, cut), missing=M.compare_archive(files, cut.where("name <> '0'")), zip=M.compare_zip_files(files, cut), exists=M.check_file_exists(part.select(F.col("p_name").alias("name")), "cold widget"), cookies=M.is_cookie_deleted(pages.select(F.col("url").alias("domain")), ["nowhere.example.net"]),
        history=M.check_history_deleted(pages, ["utm_source"]), shortcut=M.is_shortcut_on_desktop(part.select(F.concat(F.lit("Name="), "p_brand", F.lit("\n")).alias("text")), "name", "Brand#13"),
        pdf_hashes=M.compare_pdf_images(part.select(F.col("p_partkey").alias("hash_1"), F.lit(255).cast("long").alias("hash_2"))),
    )


@register(
    "metric_settings",
    _case_sql(
        prefs="select case when p_size >= 20 then 1 else 0 end from part where p_brand = 'Brand#13' order by p_partkey desc limit 1", absent="select 0", config=_when("bool_or(p_brand = 'Brand#13' and p_size = 24)", "part"),
        folders=_when("list_sort(list(distinct p_type)) = ['ECONOMY', 'PROMO', 'STANDARD']", "part"), tags=_when("bool_or(p_partkey = 1 and p_size >= 1)", "part"),
    ),
)
def metric_settings(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    prefs = part.select(F.col("p_partkey").alias("at"), F.concat(F.lit('user_pref("'), "p_brand", F.lit('", '), F.col("p_size").cast("string"), F.lit(");")).alias("line"))
    config = part.select(F.concat(F.lit("("), "p_brand", F.lit(" is "), F.col("p_size").cast("string"), F.lit(")")).alias("line"))
    marks = part.select(F.lit("folder").alias("kind"), F.col("p_type").alias("name"), F.lit(None).cast("string").alias("url"))
    return _cases(
        prefs=M.check_thunderbird_prefs(prefs, {"Brand#13": {"method": "ge", "ref": 20}}), absent=M.check_thunderbird_prefs(prefs, {"Brand#0": {"method": "ge", "ref": 0}}), config=M.check_config_status(config, ["Brand#13"], "24"),
        folders=M.is_expected_bookmarks(marks, "folder", ["STANDARD", "ECONOMY", "PROMO"]), tags=M.check_mp3_meta(part.select(F.col("p_partkey").cast("string").alias("key"), F.col("p_size").alias("value")), {"1": {"method": "ge", "ref": 1}}),
    )


# settings of a browser profile, costs and steps


@register(
    "browser_settings",
    """
select event_id, case when event_id % 2 = 1 then event_type else 'Google' end as engine, case when event_id % 3 = 0 then 'true' else 'false' end as do_not_track, case when event_id % 5 = 0 then 'true' else 'false' end as startup,
  'en-US' as language, case when event_id % 2 = 1 then 'true' else 'Google' end as deleted from events
""",
)
def browser_settings(spark, sf_dir):
    from stepweave.functions import preferences as B

    engine = F.when(F.col("event_id") % 2 == 1, F.concat(F.lit(', "default_search_provider_data": {"template_url_data": {"short_name": "'), "event_type", F.lit('"}}, "profile": {"default_content_setting_values": {}}'))).otherwise("")
    settings = F.concat(F.lit('{"enable_do_not_track": '), (F.col("event_id") % 3 == 0).cast("string"), F.lit(', "session": {"restore_on_startup": '), F.when(F.col("event_id") % 5 == 0, "5").otherwise("1"), F.lit("}"), engine, F.lit("}"))
    rows = table(spark, sf_dir, "events").select("event_id", settings.alias("s"))
    return rows.select("event_id", B.search_engine("s").alias("engine"), B.do_not_track("s").alias("do_not_track"), B.new_startup_page("s").alias("startup"), B.language("s").alias("language"), B.data_deleted_on_exit("s").alias("deleted"))


@register("cost_add", "select p_partkey, printf('%.6f', p_size + p_size * 0.5) || '€' as cost from part")
def cost_add(spark, sf_dir):
    from stepweave.functions.text import added_cost

    return table(spark, sf_dir, "part").select("p_partkey", added_cost(F.concat(F.col("p_size").cast("string"), F.lit("€")), F.concat((F.col("p_size") * 0.5).cast("string"), F.lit("$"))).alias("cost"))


@register(
    "steps_appended",
    "select conv_id, turn, segment, cast(row_number() over (partition by conv_id order by segment, turn) - 1 as integer) as at from (select conv_id, turn, case when turn < 2 then 0 else 1 end as segment from conversations)",
)
def steps_appended(spark, sf_dir):
    from stepweave.operators.steps import appended

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return appended(turns.where("turn < 2"), turns.where("turn >= 2"), ["conv_id"], "turn").select("conv_id", "turn", "segment", "at")


@register("files_chosen", "select doc_id from documents where doc_id in (0, 3, 5)")
def files_chosen(spark, sf_dir):
    from stepweave.operators.steps import chosen_files

    return chosen_files(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", [0, 3, 5])


@register("tokens_left", r"select conv_id, turn, cast(4096 - len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\t\n\x0B\f\r ]+'), lambda w: w <> '')) as bigint) as left_over from conversations")
def tokens_left(spark, sf_dir):
    from stepweave.operators import messages

    return table(spark, sf_dir, "conversations").select("conv_id", "turn", messages.tokens_left(messages.white_space_tokens(F.coalesce("text", F.lit(""))), 4096).alias("left_over"))
