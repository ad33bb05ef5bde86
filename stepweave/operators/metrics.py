"""Scoring metrics over extracted rows, registered by name.

Inputs are the rows that a decoder gives: paragraphs(doc, idx, text, ...), runs(doc, p, r, text, ...), cells(sheet, row, col, value),
shapes(slide, idx, ...), pixels(img, x, y, r, g, b, a), files(name, text or hash), lines(at, line). A metric gives one row with `score`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave.functions import rules as R
from stepweave.functions import text as T
from stepweave.functions.selectors import tree_score
from stepweave.functions.similarity import char_ratio, fuzzy_ratio, hash_distance, line_ratio, same_code, series_similarity, ssim
from stepweave.functions.urls import equal_urls, matches_all, without_query
from stepweave.operators.checks import REGISTRY, check, color_distance, every_row, image_statistics, lines_expected, mean_squared_difference, no_row, one, opaque_box, score, second_rarest_color, sharpness, some_row
from stepweave.operators.sheets import numbered

Score = DataFrame


def paired(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows of both by place: <column>_1 and <column>_2, null where one side has no such place."""
    left = a.select(*keys, *[F.col(c).alias(f"{c}_1") for c in columns], F.lit(True).alias("in_1"))
    return left.join(b.select(*keys, *[F.col(c).alias(f"{c}_2") for c in columns], F.lit(True).alias("in_2")), keys, "full")


def both_sides() -> Column:
    return F.col("in_1").isNotNull() & F.col("in_2").isNotNull()


def ratio_score(df: DataFrame, ratio: Column) -> Score:
    return df.agg(F.coalesce(F.avg(ratio), F.lit(0.0)).alias("score"))


def same_map(a: Column, b: Column) -> Column:
    return F.array_sort(F.map_entries(a)) == F.array_sort(F.map_entries(b))


# text

REGISTRY |= {
    "fuzzy_match": lambda a, b: fuzzy_ratio(a, b) / 100,
    "diff_text_file": lambda a, b: line_ratio(a, b),
    "compare_pdf_content": lambda a, b, least=0.95: score(char_ratio(a, b) >= least),
    "compare_python_pure_text": lambda a, b: score(same_code(a, b)),
    "compare_audios": lambda a, b: series_similarity(a, b),
    "compare_config": lambda a, b: score(T.col(a) == T.col(b)),
    "compare_answer": lambda a, b: score(T.col(a) == T.col(b)),
    "compare_terminal_and_txt": lambda a, b: score((T.col(a) == T.col(b)) & (T.col(a) != "")),
    "is_gold_text_included_in_pdf": lambda text, parts: score(T.contains_all(text, parts)),
    "is_added_to_steam_cart": lambda text, items: score(T.contains_all(text, items)),
    "is_in_vm_clipboard": lambda text, parts: score(T.contains_all(text, [parts] if isinstance(parts, str) else parts)),
    "is_extension_installed": lambda text, kind, name: score(F.contains(T.col(text), F.lit(name)) == F.lit(kind == "contain")),
    "is_expected_search_query": lambda url, pattern: score(T.col(url).rlike(pattern)),
    "is_expected_url_pattern_match": lambda url, patterns: score(matches_all(url, patterns)),
    "is_expected_url_without_query": lambda a, b: score(without_query(a) == without_query(b)),
    "check_font_size": lambda size, kind, low, high=None: score(T.col(size) == low if kind == "value" else (T.col(size) > low) & (T.col(size) < high)),
    "is_utc_0": lambda lines: score(F.endswith(F.try_element_at(F.split(T.col(lines), "\n"), F.lit(4)), F.lit("+0000)"))),
    "check_moved_jpgs": lambda have, want: score((F.size(T.col(have)) == F.size(T.col(want))) & R.same_set(have, want)),
    "check_qt_bgcone": lambda text, want: score(T.last_value_of(text, "qt-bgcone", "1") == F.lit(str(want))),
    "check_qt_max_volume": lambda text, want: score(T.last_value_of(text, "qt-max-volume", "125") == F.lit(str(want))),
    "check_qt_minimal_view": lambda text, want: score(T.last_value_of(text, "qt-minimal-view", "0") == F.lit(str(want))),
    "check_one_instance_when_started_from_file": lambda text, want: score(T.last_value_of(text, "one-instance-when-started-from-file", "1") == F.lit(str(want))),
    "check_global_key_play_pause": lambda text, want: score(F.when(T.last_value_of(text, "global-key-play-pause", "") != "", "1").otherwise("0") == F.lit(str(want))),
    "is_vlc_recordings_folder": lambda text, path: score(T.stripped(F.regexp_extract(T.col(text), r"(?m)^input-record-path=(.*)$", 1)) == F.lit(path)),
    "get_gimp_export_path": lambda text: T.filled(F.regexp_extract(T.col(text), r'(?m)^\(export-path "([^"]*)"\)', 1)),
    "check_json_keybindings": lambda have, want: score(F.exists(F.from_json(F.regexp_replace(T.col(have), r"\A\s*//[^\n]*\n", ""), "array<map<string,string>>"), lambda m: same_map(m, T.col(want)))),
    "check_html_background_image": lambda html, name: score(F.exists(F.regexp_extract_all(T.col(html), F.lit(r"(?s)<style[^>]*>(.*?)</style>"), F.lit(1)), lambda x: F.contains(x, F.lit(f"background-image: url('{name}')")))),
    "check_presenter_console_disable": lambda xml: score(F.lower(F.xpath_string(T.col(xml), F.lit("//*[local-name()='prop'][@*[local-name()='name']='EnablePresenterScreen']/*[local-name()='value']"))) == "false"),
    "find_default_font": lambda xml, font: score(F.xpath_string(T.col(xml), F.lit("//*[local-name()='prop'][@*[local-name()='name']='Standard']/*[local-name()='value']")) == F.lit(font)),
    "check_auto_saving_time": lambda xml, minutes: score(F.xpath_string(T.col(xml), F.lit("//*[local-name()='prop'][@*[local-name()='name']='AutoSaveTimeIntervall']/*[local-name()='value']")).try_cast("int") == minutes),
    "check_left_panel": lambda xml: score(F.xpath_boolean(T.col(xml), F.lit("boolean(//*[local-name()='document-frame'][@name='Slides View'])"))),
    "check_transition": lambda xml, kind: score(F.xpath_boolean(T.col(xml), F.lit(f"boolean(//*[local-name()='transition']/*[local-name()='{kind}'])"))),
    "check_pdf_pages": lambda pages, method, ref: score(R.rule(pages, method, ref)),
    "extract_answers_from_pdf": T.answer_after_equals,
    "infeasible": lambda last_action: score(F.upper(F.trim(T.col(last_action))) == "FAIL"),
    "is_vlc_playing": lambda state, name, want: score((T.col(state) == "playing") & F.endswith(T.col(name), F.lit(want))),
    "compare_time_in_speedtest_results": lambda written, now, minutes: score(F.abs(F.unix_timestamp(T.col(written)) - F.unix_timestamp(T.col(now))) <= minutes * 60),
    "evaluate_conversion": lambda text: score(~((T.col(text) == F.upper(T.col(text))) & (F.upper(T.col(text)) != F.lower(T.col(text))))),
}


@check
def fuzzy_place_math(paragraphs: DataFrame, answers: list[str]) -> Score:
    """Three words, each by its best ratio to an answer; another number of words scores 0."""
    words = paragraphs.select(F.posexplode(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("at", "word"), "idx")
    best = F.greatest(*[fuzzy_ratio(F.col("word"), F.lit(a)) for a in answers], F.lit(0.0))
    return words.agg(F.when(F.count(F.lit(1)) == 3, F.avg(best / 100)).otherwise(0.0).alias("score"))


# Fixed value: a time of day with seconds.
TIME_OF_DAY = r"([01][0-9]|2[0-3]):[0-5][0-9]:([0-5][0-9]|60)"


@check
def check_line_number(lines: DataFrame, expected: int, pattern: str = TIME_OF_DAY) -> Score:
    return one(lines, F.count_if(F.col("line").rlike(pattern)) == expected)


@check
def check_accessibility_tree(nodes: DataFrame, rules: list[dict]) -> Score:
    """rules: where (a Column over node rows), text, exact. No node found scores 0; best text score of each rule, multiplied."""
    out = F.lit(1.0)
    for r in rules:
        found = F.coalesce(F.bool_or(r["where"]), F.lit(False)).cast("double")
        if "text" in r:
            own = F.when(F.col("text") == r["text"], 1.0).otherwise(0.0) if r.get("exact", True) else fuzzy_ratio(F.coalesce("text", F.lit("")), F.lit(r["text"])) / 100
            found = F.coalesce(F.max(F.when(r["where"], own)), F.lit(0.0))
        out = out * found
    return nodes.agg(out.alias("score"))


REGISTRY["check_accessibility_xml"] = tree_score


@check
def check_json(documents: DataFrame, json: str, expect: list[dict], unexpect: list[dict] = ()) -> Score:
    """Rules over paths {key: [...], method, ref}: a missing expected path fails; a missing unexpected one doesn't matter."""

    def met(r):
        path = "$" + "".join(f"[{k}]" if isinstance(k, int) else f"['{k}']" for k in r["key"])
        kind = {bool: "boolean", int: "bigint", float: "double"}.get(type(r["ref"]), "string")
        return R.rule(F.expr(f"try_variant_get(try_parse_json({json}), {path!r}, '{kind}')".replace(repr(path), '"' + path + '"')), r["method"], r["ref"])

    found = F.lit(True)
    for r in expect:
        found = found & met(r)
    for r in unexpect:
        found = found & ~met(r)
    return documents.select(score(found).alias("score"))


@check
def check_direct_json_object(documents: DataFrame, have: str, expected: dict, contains: bool = False) -> Score:
    """Each expected key has its value (or, with contains, a text that holds it). have: a column of map<string,string>."""
    found = F.lit(True)
    for k, v in expected.items():
        own = F.try_element_at(F.col(have), F.lit(k))
        found = found & F.coalesce(F.contains(own, F.lit(str(v))) if contains else own == F.lit(str(v)), F.lit(False))
    return documents.select(score(found).alias("score"))


@check
def is_included_all_json_objects(gold: DataFrame, result: DataFrame) -> Score:
    """gold and result as (key, value) rows: the gold ones are among the others."""
    missing = gold.select("key", "value").join(result.select("key", "value"), ["key", "value"], "left_anti")
    return no_row(missing, F.lit(True))


# tables


@check
def compare_csv(result: DataFrame, expected: list[DataFrame], strict: bool = True, ignore_case: bool = False) -> Score:
    """Lines(at, line) equal to those of one of the expected files; otherwise stripped lines, and empty ones left out.

    Lines meet by their places, so a file is never brought into one row."""

    def lines(df):
        line = F.lower("line") if ignore_case else F.col("line")
        rows = df.select("at", (line if strict else T.stripped(line)).alias("line"))
        return numbered(rows if strict else rows.where("line <> ''"), "at", "k")

    own, scores = lines(result), None
    for e in expected:
        found = every_row(paired(own, lines(e), ["k"], ["line"]), both_sides() & (F.col("line_1") == F.col("line_2")))
        scores = found if scores is None else scores.unionByName(found)
    return scores.agg(F.max("score").alias("score"))


@check
def compare_table(result: dict[str, DataFrame], expected: dict[str, DataFrame], rules: list[dict]) -> Score:
    """Rules in order over named tables; the lowest score is the table's.

    sheet_name: equal lists of names; sheet_print: equal lines (at, line) of the printed sheets, whatever their case if asked for; sheet_data: cells equal after rounding to 4 digits; sheet_fuzzy: cells under normalizing rules;
    style, freeze, zoom, row_props, col_props, filter, chart, sparkline, pivot_table, data_validation: rows of properties (keys, values)
    equal, or each meeting a rule; check_cell: a value under a rule."""
    spark = next(iter([*result.values(), *expected.values()])).sparkSession
    scores = None
    for r in rules:
        kind = r["type"]
        if kind == "sheet_name":
            found = spark.range(1).select(F.lit(float(list(result) == list(expected))).alias("score"))
        elif kind == "sheet_print":
            found = compare_csv(result[r["sheet"]], [expected[r["sheet"]]], ignore_case=r.get("ignore_case", False))
        elif kind == "sheet_data":
            found = cells_agree(result[r["sheet"]], expected[r["sheet"]])
        elif kind == "sheet_fuzzy":
            found = fuzzy_cells(result[r["sheet"]], expected[r["sheet"]], r["rules"])
        elif kind == "check_cell":
            found = no_row(spark.range(1), F.lit(False))
            cell = result[r["sheet"]].where((F.col("row") == r["row"]) & (F.col("col") == r["col"]))
            found = some_row(cell, R.rule(r.get("prop", "value"), r["method"], r["ref"]))
        elif "method" in r:
            found = some_row(result[r["table"]], R.rule(r["prop"], r["method"], r["ref"]))
        else:
            found = REGISTRY["tables_equal"](result[r["table"]], expected[r["table"]])
        scores = found if scores is None else scores.unionByName(found)
    return scores.agg(F.min("score").alias("score"))


@check
def cells_agree(a: DataFrame, b: DataFrame, digits: int = 4) -> Score:
    """Cells (row, col, value): numbers after rounding, else texts; both sides have the same cells."""
    number = lambda c: F.round(F.col(c).try_cast("double"), digits)
    both = paired(a, b, ["row", "col"], ["value"])
    same = F.when(number("value_1").isNotNull(), number("value_1") == number("value_2")).otherwise(F.col("value_1").eqNullSafe(F.col("value_2")))
    return every_row(both, both_sides() & same)


@check
def fuzzy_cells(a: DataFrame, b: DataFrame, rules: list[dict]) -> Score:
    """rules: cells (row, col ranges), type includes | included_by | fuzzy_match | exact_match, and the normalizing chain."""
    both, out = paired(a, b, ["row", "col"], ["value"]), F.lit(True)
    for r in rules:
        inside = F.col("row").between(*r["rows"]) & F.col("col").between(*r["cols"])
        chain = {k: r[k] for k in ("replace", "lstrip", "rstrip", "drop", "lower") if k in r}
        x, y = T.rule_chain("value_1", **chain), T.rule_chain("value_2", **chain)
        met = {"includes": lambda: F.contains(x, y), "included_by": lambda: F.contains(y, x), "fuzzy_match": lambda: fuzzy_ratio(x, y) >= r.get("threshold", 85.0), "exact_match": lambda: x == y}[r["type"]]()  # noqa: B023
        out = out & F.coalesce(F.bool_and(F.when(inside, F.coalesce(met, F.lit(False)))), F.lit(True))
    return one(both, out)


# documents


@check
def compare_init_lines(a: DataFrame, b: DataFrame) -> Score:
    """Paragraphs at places that both have are equal."""
    return every_row(paired(a, b, ["idx"], ["text"]).where(both_sides()), F.col("text_1") == F.col("text_2"))


@check
def compare_docx_files_fuzzy(a: DataFrame, b: DataFrame) -> Score:
    """Mean ratio of paragraphs by place; one without a partner counts 0."""
    return ratio_score(paired(a, b, ["idx"], ["text"]), F.coalesce(fuzzy_ratio("text_1", "text_2") / 100, F.lit(0.0)))


@check
def compare_line_spacing(a: DataFrame, b: DataFrame) -> Score:
    return every_row(paired(a, b, ["idx"], ["text", "spacing"]), both_sides() & F.col("text_1").eqNullSafe(F.col("text_2")) & F.col("spacing_1").eqNullSafe(F.col("spacing_2")))


@check
def compare_runs(a: DataFrame, b: DataFrame, flag: str) -> Score:
    """Some run pair has the flag on both sides: an equation, a subscript."""
    return some_row(paired(a, b, ["p", "r"], [flag]).where(both_sides()), F.col(f"{flag}_1") & F.col(f"{flag}_2"))


@check
def compare_contains_image(a: DataFrame, b: DataFrame) -> Score:
    return every_row(paired(a, b, ["p", "r"], ["has_image"]).where(both_sides()), F.col("has_image_1") == F.col("has_image_2"))


@check
def compare_font_names(runs: DataFrame, font: str) -> Score:
    return every_row(runs, F.col("font") == font)


@check
def contains_page_break(runs: DataFrame, expected: int | None = None) -> Score:
    n = F.count_if(F.col("page_break"))
    return one(runs, (n > 0) & (n == expected if expected is not None else F.lit(True)))


@check
def has_page_numbers_in_footers(footers: DataFrame) -> Score:
    return every_row(footers, F.col("text").rlike("[0-9]"))


@check
def is_first_line_centered(paragraphs: DataFrame) -> Score:
    return one(paragraphs, F.min_by("alignment", "idx") == "center")


def by_document(df: DataFrame, order: str):
    """Rows of a document in order; without a column `doc` all rows are of one document, which then is one task's."""
    return Window.partitionBy("doc").orderBy(order) if "doc" in df.columns else Window.orderBy(order)


@check
def check_tabstops(a: DataFrame, b: DataFrame, width: float, words: int | None = None, index: int = 0) -> Score:
    """Paragraphs with text, by order: 1 minus the mean distance of their tab stops, in widths of the text.

    stops: array of (position, alignment); cleared ones and left ones at 0 don't count. Other numbers of paragraphs or of stops, or
    other alignments, score 0. words: so many words in piece `index` between the tabs of each paragraph of the first document."""
    real = lambda c: F.filter(c, lambda t: ~((F.lower(t["alignment"]) == "clear") | ((F.lower(t["alignment"]) == "left") & (t["position"] == 0))))

    def own(df):
        rows = df.where(F.trim("text") != "").withColumn("stops", real(F.coalesce("stops", F.array().cast(dict(df.dtypes)["stops"]))))
        return rows.withColumn("k", F.row_number().over(by_document(rows, "idx")))

    both = paired(own(a), own(b), [*(["doc"] if "doc" in a.columns else []), "k"], ["stops", "text"])
    alike = F.transform("stops_1", lambda t: F.lower(t["alignment"])) == F.transform("stops_2", lambda t: F.lower(t["alignment"]))
    far = F.aggregate(F.zip_with("stops_1", "stops_2", lambda x, y: F.abs(x["position"] - y["position"]).cast("double")), F.lit(0.0), lambda s, x: s + x)
    lost = F.when(both_sides() & alike, far / width)
    if words is not None:
        piece = F.get(F.split("text_1", r"\t"), index)
        lost = F.when(F.size(F.filter(F.split(piece, r"\s"), lambda w: w != "")) == words, lost)
    return both.agg(F.when(F.bool_and(lost.isNotNull()), 1 - F.avg(lost)).otherwise(0.0).alias("score"))


@check
def evaluate_strike_through_last_paragraph(runs: DataFrame) -> Score:
    """By paragraph first: a document's runs need not meet in one task."""
    paragraphs = runs.groupBy("doc", "p").agg(F.bool_and(F.coalesce("strike", F.lit(False))).alias("strike"))
    return every_row(paragraphs.groupBy("doc").agg(F.max_by("strike", "p").alias("strike")), F.col("strike"))


@check
def evaluate_spacing(paragraphs: DataFrame) -> Score:
    """The first three: 1.0, 2.0, 1.5."""
    first = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("idx", "spacing"))), lambda s: s["spacing"]), 1, 3)
    return paragraphs.agg(score(first == F.array(F.lit(1.0), F.lit(2.0), F.lit(1.5))).alias("score"))


@check
def check_italic_font_size_14(runs: DataFrame) -> Score:
    return every_row(runs, ~F.coalesce("italic", F.lit(False)) | (F.col("size") == 14))


@check
def check_highlighted_words(spans: DataFrame) -> Score:
    return no_row(spans, F.col("highlight") == "yellow")


@check
def evaluate_alignment(paragraphs: DataFrame) -> Score:
    """Each sentence begins with its first three words, set before the rest by a tab."""
    sentences = paragraphs.select(F.explode(F.filter(F.split("text", r"\."), lambda s: F.trim(s) != "")).alias("s"))
    head = F.array_join(F.slice(F.split(F.trim("s"), r"\s+"), 1, 3), " ")
    return every_row(sentences, F.startswith(F.regexp_replace(F.trim("s"), r"\s+", " "), head) & F.contains(F.trim("s"), F.lit("\t")))


@check
def evaluate_colored_words(words: DataFrame) -> Score:
    """Words by their first letter: a vowel in red, others in blue, within a small distance."""
    vowel = F.lower(F.substring("text", 1, 1)).isin(*"aeiou")
    near = lambda to: color_distance(F.col("r"), F.col("g"), F.col("b"), to) < 0.05
    return every_row(words, F.when(vowel, near((255, 0, 0))).otherwise(near((0, 0, 255))))


@check
def compare_highlighted_text(a: DataFrame, b: DataFrame) -> Score:
    return REGISTRY["line_sets_equal"](a.where("highlight is not null"), b.where("highlight is not null"), "text")


@check
def compare_references(a: DataFrame, b: DataFrame, indicator: str, base: float) -> Score:
    """Paragraphs after the indicator, by order: mean ratio, rescaled; other counts score 0."""

    def after(df):
        at = df.where(F.col("text") == indicator).agg(F.max("idx").alias("at"))
        rows = df.join(F.broadcast(at), F.col("idx") > F.col("at")).where("trim(text) <> ''")  # one row
        return rows.withColumn("k", F.row_number().over(by_document(rows, "idx")))

    both = paired(after(a), after(b), ["k"], ["text"])
    mean = F.when(F.bool_and(both_sides()), F.avg(fuzzy_ratio("text_1", "text_2") / 100))
    return both.agg(mean.alias("m")).select(F.coalesce(R.rescaled("m", base), F.lit(0.0)).alias("score"))


@check
def compare_unique_train_records(result: DataFrame, initial: DataFrame, gold: DataFrame) -> Score:
    """Stripped lines that are not empty: those of the result are among the initial ones and as many as the gold ones; its ids (the second
    of four fields) are all different, and those of the gold lines."""
    own = lambda df: df.select(T.stripped("line").alias("line")).where("line <> ''").select("line", T.record_field("line", 2).alias("id"))
    mine, wanted = own(result), own(gold)
    foreign = mine.join(own(initial), "line", "left_anti").agg(F.count(F.lit(1)).alias("foreign"))
    ids = lambda df, name: df.where("id is not null").select("id").distinct().withColumn(name, F.lit(1))
    both = ids(mine, "a").join(ids(wanted, "b"), "id", "full").agg(F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("off"))
    counts = mine.agg(F.count(F.lit(1)).alias("lines"), F.count("id").alias("n"), F.count_distinct("id").alias("d"))
    return counts.crossJoin(wanted.agg(F.count(F.lit(1)).alias("gold"))).crossJoin(foreign).crossJoin(both).select(score((F.col("n") == F.col("d")) & (F.col("lines") == F.col("gold")) & (F.col("foreign") == 0) & (F.col("off") == 0)).alias("score"))  # one row each


# slides


@check
def compare_pptx_files(a: DataFrame, b: DataFrame, features: tuple[str, ...] = ("text", "left", "top", "width", "height", "bold", "italic", "underline", "alignment", "font", "size", "color"), tolerance: float = 0.005) -> Score:
    """Runs by (slide, shape, paragraph, run): chosen features equal; numbers within a share; no boldness is none, no alignment is left."""
    default = {"bold": F.lit(False), "italic": F.lit(False), "underline": F.lit(False), "alignment": F.lit("left")}
    kinds = dict(a.dtypes)
    same = both_sides()
    for f in features:
        x, y = F.col(f"{f}_1"), F.col(f"{f}_2")
        if f in default:
            x, y = F.coalesce(x, default[f]), F.coalesce(y, default[f])
        near = F.abs(x - y) <= F.greatest(F.abs(x), F.abs(y)) * tolerance if kinds[f] in ("double", "float", "int", "bigint") else F.lit(False)
        same = same & (x.eqNullSafe(y) | F.coalesce(near, F.lit(False)))
    return every_row(paired(a, b, ["slide", "shape", "paragraph", "run"], list(features)), same)


@check
def check_image_stretch_and_center(shapes: DataFrame, width: float, height: float, near: float = 0.5) -> Score:
    """An image as large as the slide, about, and in its middle."""
    middle = lambda at, size, whole: F.abs(F.col(at) + F.col(size) / 2 - whole / 2) < near
    return some_row(shapes.where("kind = 'picture'"), (F.abs(F.col("width") - width) < near) & (F.abs(F.col("height") - height) < near) & middle("left", "width", width) & middle("top", "height", height))


@check
def check_strikethrough(runs: DataFrame, slides: list[int], shapes: list[int], paragraphs: list[int]) -> Score:
    chosen = runs.where(F.col("slide").isin(slides) & F.col("shape").isin(shapes) & F.col("paragraph").isin(paragraphs) & (F.col("run") == 0))
    return every_row(chosen, F.coalesce("strike", F.lit(False)))


@check
def check_slide_numbers_color(shapes: DataFrame) -> Score:
    """The first shape whose text is a number is red; none scores 0."""
    first = F.min_by(F.struct("r", "g", "b"), F.struct("slide", "idx"))
    return shapes.where(F.trim("text").rlike("^[0-9]+$")).agg(first.alias("c")).select(score((F.col("c.r") == 255) & (F.col("c.g") == 0) & (F.col("c.b") == 0)).alias("score"))


@check
def check_page_number_colors(shapes: DataFrame, color: str, margin: int = 50) -> Score:
    """The master's number color is red, blue, green or black, by a margin between channels."""
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    rules = {"red": (r > g + margin) & (r > b + margin), "blue": (b > g + margin) & (b > r + margin), "green": (g > r + margin) & (g > b + margin), "black": (r < margin) & (g < margin) & (b < margin)}
    return some_row(shapes, rules[color])


@check
def evaluate_presentation_fill_to_rgb_distance(slides: DataFrame, color: tuple[int, int, int]) -> Score:
    """1 minus the mean distance of the slides' fills; unknown and unchanged fills count 1."""
    far = F.when(F.col("r").isNull() | F.coalesce("unchanged", F.lit(False)), 1.0).otherwise(color_distance(F.col("r"), F.col("g"), F.col("b"), color))
    return slides.agg((1 - F.avg(far)).alias("score"))


# images


def _compared(a: DataFrame, b: DataFrame, column: str, less: bool) -> Score:
    x, y = image_statistics(a).select(F.col(column).alias("x")), image_statistics(b).select(F.col(column).alias("y"))
    return x.crossJoin(y).select(score(F.col("x") < F.col("y") if less else F.col("x") > F.col("y")).alias("score"))  # one image each


@check
def increase_saturation(a: DataFrame, b: DataFrame) -> Score:
    return _compared(a, b, "saturation", less=True)


@check
def decrease_brightness(a: DataFrame, b: DataFrame) -> Score:
    return _compared(a, b, "brightness", less=False)


@check
def increase_contrast(a: DataFrame, b: DataFrame) -> Score:
    return _compared(a, b, "contrast", less=True)


@check
def check_sharper(a: DataFrame, b: DataFrame) -> Score:
    x, y = sharpness(a).select(F.col("sharpness").alias("x")), sharpness(b).select(F.col("sharpness").alias("y"))
    return x.crossJoin(y).select(score(F.col("x") > F.col("y")).alias("score"))  # one image each


@check
def structure_check_by_mse(a: DataFrame, b: DataFrame, most: float = 0.03) -> Score:
    return mean_squared_difference(a, b).select(score(F.col("mse") < most).alias("score"))


def image_similarity(a: DataFrame, b: DataFrame, planes: str = "rgb") -> DataFrame:
    """(img, ssim): mean structural similarity of the planes of two images of one name, 0 where sizes differ or are too small.

    An image is one group: its pixels become matrices there."""
    columns = ["img", "x", "y", *planes]
    both = a.select(*columns).withColumn("side", F.lit(0)).unionByName(b.select(*columns).withColumn("side", F.lit(1)))
    kind = dict(a.dtypes)["img"]

    def matrices(pdf):
        rows, cols = (pdf["y"] - pdf["y"].min()).to_numpy(), (pdf["x"] - pdf["x"].min()).to_numpy()
        out = np.zeros((len(planes), rows.max() + 1, cols.max() + 1))
        for i, c in enumerate(planes):
            out[i, rows, cols] = pdf[c]
        return out

    def similar(pdf):
        first, second = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        found = 0.0
        if len(first) and len(second):
            found = float(np.mean([ssim(x, y) if x.shape == y.shape else 0.0 for x, y in zip(matrices(first), matrices(second), strict=True)]))
        return pd.DataFrame({"img": pdf["img"].iloc[:1], "ssim": [found]})

    return both.groupBy("img").applyInPandas(similar, f"img {kind}, ssim double")


def resized(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Each image at another size: every target pixel takes the source pixel whose area holds its middle. One row a target pixel."""
    size = pixels.groupBy("img").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"))
    place = lambda at, whole, first, own: F.floor((F.col(at) + 0.5) * F.col(own) / whole) + F.col(first)
    grid = size.select("img", "x0", "y0", "w", "h", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("tx")).select("*", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("ty"))
    grid = grid.select("img", "tx", "ty", place("tx", width, "x0", "w").cast("long").alias("x"), place("ty", height, "y0", "h").cast("long").alias("y"))
    others = [c for c in pixels.columns if c not in ("img", "x", "y")]
    return grid.join(pixels, ["img", "x", "y"]).select("img", F.col("tx").alias("x"), F.col("ty").alias("y"), *others)


def normalized_brightness(pixels: DataFrame, target: float = 128.0) -> DataFrame:
    """Each image with its channels scaled so that its mean brightness is the target, within 0 to 255."""
    scale = image_statistics(pixels).select("img", F.when(F.col("brightness") > 0, F.lit(target) / F.col("brightness")).otherwise(1.0).alias("_scale"))
    return pixels.join(scale, "img").select(*[(F.least(F.lit(255), F.floor(F.col(c) * F.col("_scale"))).alias(c) if c in "rgb" else F.col(c)) for c in pixels.columns])


def _structure(a: DataFrame, b: DataFrame, least: float = 0.9, planes: str = "rgb") -> Score:
    return every_row(image_similarity(a, b, planes), F.col("ssim") >= least)


def _all(*scores: Score) -> Score:
    found = scores[0]
    for more in scores[1:]:
        found = found.unionByName(more)
    return found.agg(F.min("score").alias("score"))


def hue_and_value(pixels: DataFrame) -> DataFrame:
    """Hue (0 to 255) and value of each pixel, as planes h and v."""
    high, low = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    span = high - low
    part = lambda c: (high - F.col(c)) / span
    turn = F.when(F.col("r") == high, part("b") - part("g")).when(F.col("g") == high, 2 + part("r") - part("b")).otherwise(4 + part("g") - part("r")) / 6
    hue = F.when(span == 0, F.lit(0)).otherwise(F.floor((turn - F.floor(turn)) * 255))
    return pixels.select("img", "x", "y", hue.alias("h"), high.alias("v"))


@check
def check_structure_sim(a: DataFrame, b: DataFrame, least: float = 0.9) -> Score:
    return _structure(a, b, least)


@check
def check_structure_sim_resized(a: DataFrame, b: DataFrame, width: int, height: int) -> Score:
    """The source without what is transparent, at the target's size, is like the target."""
    return _structure(resized(a.where("a > 0") if "a" in a.columns else a, width, height), b)


@check
def check_brightness_decrease_and_structure_sim(a: DataFrame, b: DataFrame, most: float = 0.03) -> Score:
    """The first is darker, and like the second once both have one brightness."""
    return _all(_compared(a, b, "brightness", less=True), structure_check_by_mse(normalized_brightness(a), normalized_brightness(b), most))


@check
def check_saturation_increase_and_structure_sim(a: DataFrame, b: DataFrame) -> Score:
    """The first is more saturated; hues and values are alike."""
    x, y = hue_and_value(a), hue_and_value(b)
    return _all(_compared(a, b, "saturation", less=False), _structure(x, y, planes="h"), _structure(x, y, planes="v"))


@check
def check_contrast_increase_and_structure_sim(a: DataFrame, b: DataFrame) -> Score:
    return _all(_compared(a, b, "contrast", less=False), _structure(a, b, 0.65))


@check
def check_palette_and_structure_sim(a: DataFrame, b: DataFrame, palette: bool) -> Score:
    """palette: whether the source file holds a palette, which pixels don't tell."""
    return _all(_structure(a, b), a.sparkSession.range(1).select(F.lit(float(palette)).alias("score")))


@check
def compare_triangle_positions(a: DataFrame, b: DataFrame, near: float = 5.0) -> Score:
    """The centres of both images' second rarest color are near each other."""
    x, y = (second_rarest_color(d).select("img", F.col("cx").alias(f"x{i}"), F.col("cy").alias(f"y{i}")) for i, d in enumerate((a, b)))
    return every_row(x.join(y, "img", "full"), F.coalesce(F.hypot(F.col("x0") - F.col("x1"), F.col("y0") - F.col("y1")) <= near, F.lit(False)))


REGISTRY["check_file_exists_and_structure_sim"] = REGISTRY["compare_images"] = REGISTRY["structure_check_by_ssim"] = check_structure_sim


@check
def check_file_exists(files: DataFrame, name: str) -> Score:
    return some_row(files, F.col("name") == name)


@check
def compare_pdfs(pairs: DataFrame) -> Score:
    """pairs(text_1, text_2): their mean fuzzy ratio."""
    return ratio_score(pairs, fuzzy_ratio("text_1", "text_2") / 100)


@check
def compare_docx_images(a: DataFrame, b: DataFrame) -> Score:
    """images(idx, hash) of two documents are equal, place by place."""
    return every_row(paired(a, b, ["idx"], ["hash"]), both_sides() & (F.col("hash_1") == F.col("hash_2")))


@check
def compare_image_list(a: DataFrame, b: DataFrame) -> Score:
    return every_row(paired(a, b, ["img", "x", "y"], list("rgb")), both_sides() & (F.col("r_1") == F.col("r_2")) & (F.col("g_1") == F.col("g_2")) & (F.col("b_1") == F.col("b_2")))


@check
def check_image_mirror(a: DataFrame, b: DataFrame, width: int, most: float = 8.0) -> Score:
    """The second is the first mirrored: mean distance of channels below `most`."""
    mirrored = a.withColumn("x", width - 1 - F.col("x"))
    off = sum((F.abs(F.col(f"{c}_1") - F.col(f"{c}_2")) for c in "rgb"), F.lit(0)) / 3
    return paired(mirrored, b, ["x", "y"], list("rgb")).agg(score(F.bool_and(both_sides()) & (F.avg(off) < most)).alias("score"))


@check
def check_green_background(a: DataFrame, b: DataFrame) -> Score:
    """Where the target is not black, green leads in the source."""
    both = paired(a, b, ["x", "y"], list("rgb")).where("r_2 + g_2 + b_2 > 0")
    return every_row(both, (F.col("g_1") > F.col("r_1")) & (F.col("g_1") > F.col("b_1")))


@check
def check_triangle_position(pixels: DataFrame, width: int, height: int, near: float = 0.05) -> Score:
    """The second rarest color's centre is in the middle of the image."""
    return every_row(second_rarest_color(pixels), (F.abs(F.col("cx") - width / 2) < near * width) & (F.abs(F.col("cy") - height / 2) < near * height))


@check
def check_textbox_on_leftside(pixels: DataFrame, width: int) -> Score:
    gray = F.col("r") * 0.299 + F.col("g") * 0.587 + F.col("b") * 0.114
    return one(pixels, F.min(F.when(gray < 128, F.col("x"))) < 0.05 * width)


@check
def check_image_size(pixels: DataFrame, width: int | None = None, height: int | None = None) -> Score:
    """The size of what is not transparent."""
    box = opaque_box(pixels)
    met = (F.lit(True) if width is None else F.col("width") == width) & (F.lit(True) if height is None else F.col("height") == height)
    return every_row(box, met)


@check
def compare_pdf_images(pairs: DataFrame, most: int = 5) -> Score:
    """pairs(hash_1, hash_2): the share whose hashes differ in few bits."""
    return pairs.agg(F.coalesce(F.avg((hash_distance("hash_1", "hash_2") <= most).cast("double")), F.lit(0.0)).alias("score"))


@check
def compare_videos(frames_1: DataFrame, frames_2: DataFrame, most: int = 5) -> Score:
    """frames(at, hash): equal numbers, and few frames whose hashes differ."""
    both = paired(frames_1, frames_2, ["at"], ["hash"])
    return one(both, F.bool_and(both_sides()) & (F.count_if(hash_distance("hash_1", "hash_2") > most) <= most))


# files, pages and settings


@check
def compare_archive(a: DataFrame, b: DataFrame, compare: Column | None = None) -> Score:
    """files(name, hash, text) of two archives: the same names, then the mean of a comparison (equal bytes by default)."""
    both = paired(a, b, ["name"], ["hash", "text"])
    return both.agg(F.when(F.bool_and(both_sides()), F.avg(compare if compare is not None else (F.col("hash_1") == F.col("hash_2")).cast("double"))).otherwise(0.0).alias("score"))


@check
def compare_epub(a: DataFrame, b: DataFrame) -> Score:
    return compare_archive(a, b, line_ratio("text_1", "text_2"))


@check
def compare_zip_files(a: DataFrame, b: DataFrame) -> Score:
    same = F.when(F.endswith("name", F.lit(".pdf")), char_ratio("text_1", "text_2") >= 0.95).otherwise(F.col("hash_1") == F.col("hash_2"))
    return every_row(paired(a, b, ["name"], ["hash", "text"]), both_sides() & same)


@check
def compare_htmls(a: DataFrame, b: DataFrame, ignored: tuple[str, ...] = ("sdnum",)) -> Score:
    """Nodes(at, tag, text, attributes) by order: names, stripped texts and attributes equal."""
    own = lambda c: F.map_filter(F.col(c), lambda k, v: ~k.isin(*ignored))
    same_map = F.array_sort(F.map_entries(own("attributes_1"))) == F.array_sort(F.map_entries(own("attributes_2")))
    return every_row(paired(a, b, ["at"], ["tag", "text", "attributes"]), both_sides() & (F.col("tag_1") == F.col("tag_2")) & (T.stripped("text_1") == T.stripped("text_2")) & same_map)


@check
def is_cookie_deleted(cookies: DataFrame, domains: list[str]) -> Score:
    found = F.lit(False)
    for d in domains:
        found = found | equal_urls("domain", F.lit(d))
    return no_row(cookies, found)


@check
def check_history_deleted(history: DataFrame, keywords: list[str]) -> Score:
    return no_row(history, T.contains_any("url", keywords))


@check
def is_shortcut_on_desktop(files: DataFrame, kind: str, value: str) -> Score:
    if kind not in ("name", "exec"):
        raise ValueError(f"no shortcut check by {kind}")
    return some_row(files, F.contains("text", F.lit(f"{kind.capitalize()}={value}\n")))


def choices(alternatives: list[str | list[str]]) -> list[list[str]]:
    """All sets, sorted, that one choice of each slot can make."""
    found = {frozenset()}
    for slot in alternatives:
        found = {have | {one_of} for have in found for one_of in ([slot] if isinstance(slot, str) else slot)}
    return sorted(sorted(f) for f in found)


@check
def is_expected_bookmarks(bookmarks: DataFrame, kind: str, expected: list[str | list[str]], folder: str = "Liked Authors") -> Score:
    """bookmarks(kind, name, url, folder; folder null on the bar itself): names of the bar's folders, or its URLs, as a set.

    liked_authors: the URLs in a folder of the bar, as one of the sets that choices of the alternatives make."""
    top = F.col("folder").isNull() if "folder" in bookmarks.columns else F.lit(True)
    if kind == "liked_authors":
        has = F.coalesce(F.bool_or((F.col("kind") == "folder") & top & (F.col("name") == folder)), F.lit(False))
        urls = F.array_sort(F.collect_set(F.when((F.col("kind") == "url") & (F.col("folder") == folder), F.col("url"))))
        sets = F.array(*[F.array(*[F.lit(u) for u in c]) for c in choices(expected)])
        return bookmarks.agg(has.alias("has"), urls.alias("have")).select(score(F.col("has") & F.array_contains(sets, F.col("have"))).alias("score"))
    column = {"folder": "name", "url": "url"}[kind]
    have = bookmarks.where((F.col("kind") == kind) & top).agg(F.array_sort(F.collect_set(column)).alias("have"))
    return have.select(score(F.col("have") == F.array_sort(F.array(*[F.lit(e) for e in sorted(set(expected))]))).alias("score"))


@check
def check_config_status(lines: DataFrame, keys: list[str], value: str) -> Score:
    """Some line that is no comment begins with the keys and ends with the value."""
    parts = F.split(F.regexp_replace(T.stripped("line"), r"[()]", ""), r"\s+")
    named = F.slice(parts, 1, len(keys)) == F.array(*[F.lit(k) for k in keys])
    return some_row(lines.where(~F.startswith("line", F.lit("#"))), named & (F.element_at(parts, -1) == value))


@check
def check_thunderbird_prefs(lines: DataFrame, expect: dict[str, dict], unexpect: dict[str, dict] | None = None) -> Score:
    """The last value of each preference meets its rule (and no unexpected one)."""
    parsed = lines.select("at", T.preference("line").alias("p")).where("p.key is not null")
    last = parsed.groupBy("p.key").agg(F.max_by("p.value", "at").alias("value"))

    def met(name, r):
        kind = {bool: "boolean", int: "bigint", float: "double"}.get(type(r["ref"]), "string")
        value = F.trim(F.col("value"), F.lit('"')) if kind == "string" else F.col("value").try_cast(kind)
        return F.coalesce(F.bool_or((F.col("key") == name) & R.rule(value, r["method"], r["ref"])), F.lit(False))

    found = F.lit(True)
    for name, r in expect.items():
        found = found & met(name, r)
    for name, r in (unexpect or {}).items():
        found = found & ~met(name, r)
    return one(last, found)


# Fixed value: one condition of a mail filter.
CONDITION = r"\b(?:AND|OR) \((?:[\w ]+),(?:[\w ']+),(?:\"(?:[^\"]+)\"|(?:[^)]+))\)|\bALL\b"


def filter_records(lines: DataFrame) -> DataFrame:
    """Mail filters of (at, line), with `doc` where there are several files: a `name=` line opens a record; its fields, and conditions as an array."""
    doc = ["doc"] if "doc" in lines.columns else []
    named = lines.withColumn("record", F.sum(F.startswith("line", F.lit("name=")).cast("int")).over(by_document(lines, "at")))
    plain = lambda c: F.replace(F.replace(c, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    field = lambda k: F.max(F.when(F.startswith("line", F.lit(f"{k}=")), plain(F.regexp_extract("line", rf'^{k}="(.*)"$', 1)))).alias(k)
    rows = named.where("record > 0").groupBy(*doc, "record").agg(*[field(k) for k in ("name", "enabled", "type", "action", "actionValue", "condition")])
    return rows.where("condition is not null").withColumn("condition", F.regexp_extract_all("condition", F.lit(CONDITION), F.lit(0)))


@check
def check_thunderbird_filter(lines: DataFrame, expect: list[dict], unexpect: list[dict] = ()) -> Score:
    records = filter_records(lines).withColumn("condition", F.array_join("condition", ";"))
    text = lambda patterns: [{k: ";".join(v) if isinstance(v, list) else v for k, v in p.items()} for p in patterns]
    return REGISTRY["records_expected"](records, text(expect), text(unexpect))


def mailbox(text: Column | str, ignore_status: bool = False, ignore_keys: bool = False, keep_deleted: bool = False) -> Column:
    """Messages of a mailbox text, normalized, without deleted and repeated ones, sorted."""
    mails = F.filter(F.split(T.stripped(text), "FROM - "), lambda m: F.trim(m) != "")
    if not keep_deleted:
        mails = F.filter(mails, lambda m: ~m.rlike(r"X-Mozilla-Status: 000[89]"))
    if ignore_status:
        mails = F.transform(mails, lambda m: F.regexp_replace(m, r"X-Mozilla-Status\d?:[\s\d]+", ""))
    if ignore_keys:
        mails = F.transform(mails, lambda m: F.regexp_replace(m, r"X-Mozilla-Keys:[^\n]*?\n(MIME-Version)", "$1"))
    return F.array_sort(F.array_distinct(F.transform(mails, T.stripped)))


REGISTRY["check_thunderbird_folder"] = lambda a, b, **options: score(mailbox(a, **options) == mailbox(b, **options))
REGISTRY["check_csv"], REGISTRY["check_list"], REGISTRY["run_sqlite3"] = REGISTRY["records_expected"], lines_expected, REGISTRY["scalar_query"]
REGISTRY["compare_docx_tables"], REGISTRY["compare_docx_lines"], REGISTRY["check_no_duplicates"] = REGISTRY["cells_equal"], REGISTRY["line_sets_equal"], REGISTRY["unique_and_complete"]
REGISTRY["compare_docx_files"], REGISTRY["compare_conference_city_in_order"] = REGISTRY["ordered_texts_equal"], REGISTRY["positions_contain"]


@check
def check_mp3_meta(tags: DataFrame, rules: dict[str, dict]) -> Score:
    """tags(key, value): each named tag meets its rule."""
    found = F.lit(True)
    for name, r in rules.items():
        found = found & F.coalesce(F.bool_or((F.col("key") == name) & R.rule("value", r["method"], r["ref"])), F.lit(False))
    return one(tags, found)
