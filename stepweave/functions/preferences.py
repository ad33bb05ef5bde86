"""Settings of a browser profile: Columns over the JSON text of its preference files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.functions.text import col

# What a profile has where it says nothing, and the number of the start page that opens a new tab.
ENGINE, LANGUAGE, FRESH_START = "Google", "en-US", 5
FONTS = {"default_fixed_font_size": 13, "default_font_size": 16, "minimum_font_size": 13}
_MARK = "type string, name string, url string"
_EXTENSIONS = "map<string, struct<path: string, manifest: struct<name: string>>>"


def _at(settings: Column | str, path: str) -> Column:
    return F.get_json_object(col(settings), f"$.{path}")


def _broken(settings: Column | str) -> Column:
    return F.try_parse_json(col(settings)).isNull()


def _truthy(value: Column) -> Column:
    return F.coalesce(~value.isin("false", "0", "0.0", "", "{}", "[]"), F.lit(False))


def _said(found: Column) -> Column:
    return F.when(found, "true").otherwise("false")


def search_engine(settings: Column | str) -> Column:
    return F.coalesce(_at(settings, "default_search_provider_data.template_url_data.short_name"), F.lit(ENGINE))


def enabled_experiments(settings: Column | str) -> Column:
    return F.coalesce(F.from_json(_at(settings, "browser.enabled_labs_experiments"), "array<string>"), F.array().cast("array<string>"))


def profile_name(settings: Column | str) -> Column:
    return _at(settings, "profile.name")


def language(settings: Column | str) -> Column:
    return F.coalesce(_at(settings, "intl.app_locale"), F.lit(LANGUAGE))


def font_sizes(settings: Column | str) -> Column:
    default = F.create_map(*[F.lit(x) for pair in FONTS.items() for x in pair])
    return F.coalesce(F.from_json(_at(settings, "webkit.webprefs"), "map<string, int>"), default)


def do_not_track(settings: Column | str) -> Column:
    return _said(_truthy(_at(settings, "enable_do_not_track")))


def enhanced_safe_browsing(settings: Column | str) -> Column:
    return F.when(_broken(settings), ENGINE).otherwise(_said(_truthy(_at(settings, "safebrowsing.enhanced"))))


def safe_browsing(settings: Column | str) -> Column:
    return _said(_truthy(_at(settings, "safebrowsing.enhanced")) | _truthy(_at(settings, "safebrowsing.enabled")))


def new_startup_page(settings: Column | str) -> Column:
    fresh = _at(settings, "session").isNull() | F.coalesce(_at(settings, "session.restore_on_startup") == str(FRESH_START), F.lit(False))
    return F.when(_broken(settings), ENGINE).otherwise(_said(fresh))


def data_deleted_on_exit(settings: Column | str) -> Column:
    return F.when(_broken(settings) | _at(settings, "profile").isNull(), ENGINE).otherwise(_said(_at(settings, "profile.default_content_setting_values").isNotNull()))


def _extensions(settings: Column | str) -> Column:
    return F.map_values(F.coalesce(F.from_json(_at(settings, "extensions.settings"), _EXTENSIONS), F.from_json(F.lit("{}"), _EXTENSIONS)))


def extension_paths(settings: Column | str) -> Column:
    return F.transform(_extensions(settings), lambda e: e["path"])


def extension_names(settings: Column | str) -> Column:
    return F.transform(_extensions(settings), lambda e: e["manifest"]["name"])


def bookmarks(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, name, url, folder): the bookmark bar's own entries (folder null) and those of its folders."""
    kind = f"array<struct<{_MARK.replace(' string', ': string')}, children: array<struct<{_MARK.replace(' string', ': string')}>>>>"
    bar = files.select(key, F.explode(F.from_json(_at(text, "roots.bookmark_bar.children"), kind)).alias("b"))
    top = F.array(F.struct(F.col("b.type").alias("kind"), F.col("b.name").alias("name"), F.col("b.url").alias("url"), F.lit(None).cast("string").alias("folder")))
    inner = F.transform(F.coalesce("b.children", F.array().cast(f"array<struct<{_MARK.replace(' string', ': string')}>>")), lambda c: F.struct(c["type"].alias("kind"), c["name"].alias("name"), c["url"].alias("url"), F.col("b.name").alias("folder")))
    return bar.select(key, F.explode(F.concat(top, inner)).alias("e")).select(key, "e.*")
