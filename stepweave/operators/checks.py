"""Declarative scoring checks over extracted rows, and the registry that names them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave.functions import rules as R
from stepweave.functions import text as T
from stepweave.functions.urls import equal_urls
from stepweave.operators.sheets import numbered

#: Name -> check. A Column check takes columns; a table check takes DataFrames and gives one row with `score`.
REGISTRY: dict[str, Callable] = {}


def check(run: Callable) -> Callable:
    REGISTRY[run.__name__] = run
    return run


def score(found: Column) -> Column:
    return F.when(F.coalesce(found, F.lit(False)), 1.0).otherwise(0.0)


# tables


def one(df: DataFrame, found: Column) -> DataFrame:
    return df.agg(score(found).alias("score"))


@check
def records_expected(rows: DataFrame, expect: list[dict], unexpect: list[dict] = ()) -> DataFrame:
    """Each expected record is met by some row, and no row meets an unexpected one."""
    found = F.lit(True)
    for pattern in expect:
        found = found & F.coalesce(F.bool_or(R.record(pattern)), F.lit(False))
    for pattern in unexpect:
        found = found & ~F.coalesce(F.bool_or(R.record(pattern)), F.lit(False))
    return one(rows, found)


@check
def lines_expected(rows: DataFrame, line: str, expect: list[str], unexpect: list[str] = ()) -> DataFrame:
    """The same with regular expressions over lines."""
    found = F.lit(True)
    for pattern in expect:
        found = found & F.coalesce(F.bool_or(F.col(line).rlike(pattern)), F.lit(False))
    for pattern in unexpect:
        found = found & ~F.coalesce(F.bool_or(F.col(line).rlike(pattern)), F.lit(False))
    return one(rows, found)


@check
def tables_equal(a: DataFrame, b: DataFrame, digits: int = 4) -> DataFrame:
    """The same rows, as bags, after rounding; nulls and NaN equal themselves. One shuffle of counts, no set operators."""

    def own(df, sign):
        kinds = dict(df.dtypes)
        return df.select(*[F.round(c, digits).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in sorted(df.columns)], F.lit(sign).alias("_sign"))

    if sorted(a.columns) != sorted(b.columns):
        return a.sparkSession.range(1).select(F.lit(0.0).alias("score"))
    counts = own(a, 1).unionByName(own(b, -1)).groupBy(*sorted(a.columns)).agg(F.sum("_sign").alias("off"))
    return counts.agg(score(F.coalesce(F.bool_and(F.col("off") == 0), F.lit(True))).alias("score"))


@check
def cells_equal(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("t", "row", "col"), text: str = "text") -> DataFrame:
    """Every cell of either table has an equal one at its place; texts are stripped."""
    both = a.select(*keys, T.stripped(text).alias("_a")).join(b.select(*keys, T.stripped(text).alias("_b")), list(keys), "full")
    return one(both, F.coalesce(F.bool_and(F.col("_a").eqNullSafe(F.col("_b"))), F.lit(True)))


@check
def ordered_texts_equal(a: DataFrame, b: DataFrame, order: str, text: str, ignore_blanks: bool = False, ignore_case: bool = False, drop_empty: bool = False, collapse: bool = False) -> DataFrame:
    """Paragraphs of two documents: position by position, or as one text."""

    def own(df):
        t = F.lower(text) if ignore_case else F.col(text)
        t = T.stripped(F.regexp_replace(t, T.BLANKS, " ")) if ignore_blanks else t
        rows = df.select(F.col(order).alias("o"), t.alias("t"))
        rows = rows.where(F.trim("t") != "") if drop_empty else rows
        if collapse:  # one text is compared, so one text is made
            texts = F.transform(F.array_sort(F.collect_list(F.struct("o", "t"))), lambda s: s["t"])
            return rows.agg(F.array_join(texts, " ").alias("t")).select(F.lit(0).alias("k"), "t")
        return numbered(rows, "o", "k").select("k", "t")

    both = own(a).withColumn("a", F.lit(1)).join(own(b).select("k", F.col("t").alias("other"), F.lit(1).alias("b")), "k", "full")
    return one(both, F.coalesce(F.bool_and(F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("t").eqNullSafe(F.col("other"))), F.lit(True)))


@check
def line_sets_equal(a: DataFrame, b: DataFrame, text: str) -> DataFrame:
    """The same set of stripped lines that are not empty."""
    own = lambda df: df.select(T.stripped(text).alias("t")).where("t <> ''").distinct()
    both = own(a).withColumn("in_a", F.lit(1)).join(own(b).withColumn("in_b", F.lit(1)), "t", "full")
    return one(both, F.coalesce(F.bool_and(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()), F.lit(True)))


@check
def unique_and_complete(records: DataFrame, initial: DataFrame, key: str) -> DataFrame:
    """No key twice, and the keys of the initial records, all of them."""
    own = records.agg(F.count(key).alias("n"), F.count_distinct(key).alias("d"))
    both = records.select(F.col(key).alias("k")).distinct().withColumn("x", F.lit(1)).join(initial.select(F.col(key).alias("k")).distinct().withColumn("y", F.lit(1)), "k", "full")
    covered = both.agg(F.coalesce(F.bool_and(F.col("x").isNotNull() & F.col("y").isNotNull()), F.lit(True)).alias("same"))
    return own.crossJoin(covered).select(score((F.col("n") == F.col("d")) & F.col("same")).alias("score"))  # one row each


@check
def positions_contain(rows: DataFrame, order: str, text: str, expected: list[str | list[str]]) -> DataFrame:
    """Row i holds expected text i, or one of them if it is a list."""
    options = F.array(*[F.array(*[F.lit(x) for x in ([e] if isinstance(e, str) else e)]) for e in expected])
    texts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda s: s["t"])
    agreed = rows.agg(texts.alias("texts")).withColumn("options", options)
    found = F.forall(F.arrays_zip("texts", "options"), lambda p: F.exists(p["options"], lambda o: F.contains(p["texts"], o)))
    return agreed.select(score((F.size("texts") == len(expected)) & found).alias("score"))


@check
def last_action_is(steps: DataFrame, action: str, order: str, value: str = "FAIL") -> DataFrame:
    """The marker of tasks that can't be done: success if the last action gives up."""
    return steps.agg(score(F.max_by(F.upper(F.trim(action)), order) == value).alias("score"))


@check
def scalar_query(df: DataFrame) -> DataFrame:
    """The first cell as a score, null as 0."""
    return df.limit(1).select(F.coalesce(F.col(f"`{df.columns[0]}`").cast("double"), F.lit(0.0)).alias("score"))


@check
def no_row(rows: DataFrame, found: Column) -> DataFrame:
    return one(rows, ~F.coalesce(F.bool_or(found), F.lit(False)))


@check
def every_row(rows: DataFrame, found: Column) -> DataFrame:
    return one(rows, F.coalesce(F.bool_and(found), F.lit(True)))


@check
def some_row(rows: DataFrame, found: Column) -> DataFrame:
    return one(rows, F.coalesce(F.bool_or(found), F.lit(False)))


# columns

CHECKS = {
    "exact_match": lambda value, expected: score(T.col(value) == T.col(expected)),
    "match_in_list": lambda value, options: score(T.col(value).isin(options)),
    "is_in_list": lambda values, wanted: score(F.array_contains(T.col(values), wanted)),
    "check_include_exclude": T.include_exclude,
    "file_contains": lambda value, parts: score(T.contains_all(value, parts)),
    "literal_match": lambda a, b, ignore_case=False: score(T.equal_text(a, b, ignore_case=ignore_case)),
    "compare_text_file": lambda a, b, ignore_blanks=False, ignore_case=False: score(T.equal_text(a, b, ignore_blanks, ignore_case)),
    "is_expected_active_tab": lambda a, b: score(equal_urls(a, b)),
    "is_expected_active_tab_approximate": lambda a, b: score(equal_urls(a, b, full=False)),
    "is_expected_installed_extensions": lambda expected, installed: score(R.subset(expected, installed)),
    "is_expected_tabs": lambda a, b: score(R.list_equal_one_way(a, b, equal_urls)),
    "check_gnome_favorite_apps": lambda a, b: score((F.size(T.col(a)) == F.size(T.col(b))) & R.same_set(a, b)),
    "check_text_enlarged": lambda value: score(T.col(value).try_cast("double") > 1),
    "check_slide_orientation_portrait": lambda width, height: score(T.col(width) < T.col(height)),
    "is_vlc_fullscreen": lambda window, screen: score(T.col(window) == T.col(screen)),
    "check_libre_locale": lambda setup, locale, globs: score(T.glob_match(F.coalesce(T.col(setup), T.col(locale)), globs)),
    "check_enabled_experiments": lambda names, expected: score(F.transform(T.col(names), lambda x: F.split_part(x, F.lit("@"), F.lit(1))) == F.array(*[F.lit(e) for e in expected])),
    "compare_result_files": lambda text, target: score(F.when(T.col(target).try_cast("double").isNotNull(), F.contains(T.col(text), T.col(target)) | (F.abs(T.col(text).try_cast("double") - T.col(target).try_cast("double")) < 1e-4)).otherwise(T.stripped(text) == T.stripped(target))),
    "check_qt_slider_colours": lambda value: score(F.forall(F.split(T.col(value), ";"), lambda x: x.try_cast("int") < 100)),
    "check_image_file_size": lambda content, most: score(F.octet_length(T.col(content)) < most),
    "is_red_color": lambda r, g, b: score((T.col(r) == 255) & (T.col(g) == 0) & (T.col(b) == 0)),
    "check_json_settings": lambda have, wanted: score(F.forall(F.map_entries(T.col(wanted)), lambda e: F.try_element_at(T.col(have), e["key"]).eqNullSafe(e["value"]))),
}
REGISTRY |= CHECKS


def scored(df: DataFrame, name: str, *args, **options) -> DataFrame:
    """df with `score` of a Column check by name."""
    return df.withColumn("score", REGISTRY[name](*args, **options))


def all_checks(df: DataFrame, checks: list[tuple[str, tuple, dict]], conj: str = "and") -> DataFrame:
    """Checks by name, aligned with their arguments and options, put together as a conjunction or disjunction for each row."""
    scores = F.array(*[REGISTRY[name](*args, **options) for name, args, options in checks])
    low, high = F.array_min(scores), F.array_max(scores)
    mean = F.aggregate(scores, F.lit(0.0), lambda s, x: s + x) / F.size(scores)
    return df.withColumn("score", F.when(low == 0, 0.0).otherwise(mean) if conj == "and" else high)


# pixels(img, x, y, r, g, b, a)


def luminance() -> Column:
    return F.floor(F.col("r") * 0.299 + F.col("g") * 0.587 + F.col("b") * 0.114 + 0.5)


def saturation() -> Column:
    high, low = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    return F.when(high == 0, 0).otherwise(F.floor(255.0 * (high - low) / high))


def image_statistics(pixels: DataFrame) -> DataFrame:
    """Brightness, contrast and saturation of each image."""
    return pixels.groupBy("img").agg(F.avg(luminance()).alias("brightness"), F.stddev_pop(luminance()).alias("contrast"), F.avg(saturation()).alias("saturation"))


def sharpness(pixels: DataFrame) -> DataFrame:
    """Variance of the Laplacian inside the image: neighbours meet by keys, not by a window of rows."""
    gray = pixels.select("img", "x", "y", luminance().alias("v"))
    parts = gray.select("img", F.explode(F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), (F.col("v") * k).alias("v")) for dx, dy, k in ((0, 0, -4), (1, 0, 1), (-1, 0, 1), (0, 1, 1), (0, -1, 1))])).alias("p"))
    cells = parts.groupBy("img", "p.x", "p.y").agg(F.sum("p.v").alias("v"), F.count(F.lit(1)).alias("n")).where("n = 5")
    return cells.groupBy("img").agg(F.var_pop("v").alias("sharpness"))


def mean_squared_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of two images' channels as shares; both of one size."""
    pairs = a.join(b.select("x", "y", *[F.col(c).alias(f"{c}2") for c in "rgb"]), ["x", "y"])
    return pairs.agg(F.avg(sum((((F.col(c) - F.col(f"{c}2")) / 255.0) ** 2 for c in "rgb"), F.lit(0.0)) / 3).alias("mse"))


def second_rarest_color(pixels: DataFrame) -> DataFrame:
    """Each image's second rarest color, and the centre of its pixels."""
    counts = pixels.groupBy("img", "r", "g", "b").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    rank = F.row_number().over(Window.partitionBy("img").orderBy("n", "r", "g", "b"))
    return counts.withColumn("_rank", rank).where("_rank = 2").drop("_rank")


def opaque_box(pixels: DataFrame) -> DataFrame:
    """Width and height of each image's part that is not transparent."""
    seen = F.when(F.col("a") > 0, F.lit(1))
    return pixels.groupBy("img").agg((F.max(seen * F.col("x")) - F.min(seen * F.col("x")) + 1).alias("width"), (F.max(seen * F.col("y")) - F.min(seen * F.col("y")) + 1).alias("height"))


def color_distance(r: Column, g: Column, b: Column, to: tuple[int, int, int]) -> Column:
    """Share of the largest possible distance."""
    return F.sqrt((r - to[0]) ** 2 + (g - to[1]) ** 2 + (b - to[2]) ** 2) / (3 * 255.0**2) ** 0.5
