"""Text normalization and matching as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as SQL twins see it; `(?U)\s` takes Unicode's too.
BLANKS = r"[\t\n\x0B\f\r ]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stripped(c: Column | str) -> Column:
    return F.regexp_replace(col(c), rf"^{BLANKS}|{BLANKS}$", "")


def normalized(c: Column | str, unicode: bool = False) -> Column:
    """Stripped, lower-cased, blanks collapsed: the key under which task descriptions are equal."""
    blanks = r"(?U)\s+" if unicode else BLANKS
    once = F.regexp_replace(col(c), blanks, " ")
    return F.lower(F.trim(once))


def squeezed(c: Column | str) -> Column:
    """Lower-cased without any blank."""
    return F.lower(F.regexp_replace(col(c), BLANKS, ""))


def filled(c: Column | str) -> Column:
    """Null where the text is empty."""
    return F.nullif(col(c), F.lit(""))


def first_filled(*columns: Column | str, default: str = "") -> Column:
    return F.coalesce(*[filled(c) for c in columns], F.lit(default))


def first_not_blank(*columns: Column | str, default: str = "") -> Column:
    return F.coalesce(*[filled(stripped(c)) for c in columns], F.lit(default))


def truncated(c: Column | str, n: int, mark: str = "...") -> Column:
    return F.when(F.length(col(c)) > n, F.concat(F.substring(col(c), 1, n), F.lit(mark))).otherwise(col(c))


def contains_all(c: Column | str, parts: list[str]) -> Column:
    found = F.lit(True)
    for part in parts:
        found = found & F.contains(col(c), F.lit(part))
    return found


def contains_any(c: Column | str, parts: list[str]) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | F.contains(col(c), F.lit(part))
    return found


def include_exclude(c: Column | str, include: list[str], exclude: list[str]) -> Column:
    """1 if all of include and none of exclude are in the text; a null text scores 0."""
    return F.when(contains_all(c, include) & ~contains_any(c, exclude), 1.0).otherwise(0.0)


def equal_text(a: Column | str, b: Column | str, ignore_blanks: bool = False, ignore_case: bool = False) -> Column:
    def own(c):
        c = col(c)
        if ignore_blanks:
            c = stripped(F.regexp_replace(c, BLANKS, " "))
        return F.lower(c) if ignore_case else c

    return F.coalesce(own(a) == own(b), F.lit(False))


def rule_chain(c: Column | str, replace: list[tuple[str, str]] = (), lstrip: str = "", rstrip: str = "", drop: str = "", lower: bool = False) -> Column:
    """Replacements, then stripping of character sets, then dropped characters, then case: in this order."""
    import re

    out = col(c)
    for old, new in replace:
        out = F.replace(out, F.lit(old), F.lit(new))
    if lstrip:
        out = F.regexp_replace(out, f"^[{re.escape(lstrip)}]+", "")
    if rstrip:
        out = F.regexp_replace(out, f"[{re.escape(rstrip)}]+$", "")
    if drop:
        out = F.translate(out, drop, "")
    return F.lower(out) if lower else out


def verdict_flag(c: Column | str, key: str = "SUCCESS") -> Column:
    """`KEY: TRUE` anywhere, in any case; null where the key is missing."""
    word = F.upper(F.regexp_extract(col(c), rf"(?i){key}:\s*(true|false)", 1))
    return F.when(word == "TRUE", True).when(word == "FALSE", False)


def verdict_text(c: Column | str, key: str = "EXPLANATION") -> Column:
    """All that follows `KEY:`, over line ends too, stripped."""
    return filled(stripped(F.regexp_extract(col(c), rf"(?is){key}:\s*(.+)", 1)))


def json_body(c: Column | str) -> Column:
    """What a fenced block holds, else from the first { to the last }."""
    c = col(c)
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.coalesce(filled(fenced), filled(braces))


def code_blocks(c: Column | str) -> Column:
    """The bodies of all fenced blocks, in order."""
    return F.transform(F.regexp_extract_all(col(c), F.lit(r"(?s)```(?:\w+\s*\n)?(.*?)```"), F.lit(1)), stripped)


def cost_value(c: Column | str) -> Column:
    """The first number of a cost such as 0.0003$; 0 without one."""
    return F.coalesce(F.regexp_extract(col(c), r"([0-9.]+)", 1).try_cast("double"), F.lit(0.0))


# Currency signs and what one unit counts in the common currency; the first is the default.
RATES = {"￥": 1.0, "¥": 1.0, "$": 7.2, "€": 7.8, "£": 9.1}


def cost_sign(c: Column | str) -> Column:
    return F.coalesce(filled(F.regexp_extract(col(c), r"[0-9.]+([￥$€£¥]+)", 1)), F.lit("￥"))


# Signs that a cost may hold, in the order in which they are looked for.
COST_SIGNS = ["$", "￥", "¥", "€", "£"]


def added_cost(a: Column | str, b: Column | str) -> Column:
    """The sum of two cost texts, to six digits, with the first one's sign. A text without a sign counts in the first of COST_SIGNS."""
    sign = lambda c: F.coalesce(*[F.when(F.contains(col(c), F.lit(s)), F.lit(s)) for s in COST_SIGNS], F.lit(COST_SIGNS[0]))
    value = lambda c: F.coalesce(F.trim(F.translate(col(c), "".join(COST_SIGNS), "")).try_cast("double"), F.lit(0.0))
    return F.concat(F.format_string("%.6f", value(a) + value(b)), sign(a))


def common_cost(c: Column | str) -> Column:
    rates = F.create_map(*[F.lit(x) for pair in RATES.items() for x in pair])
    return cost_value(c) * F.coalesce(F.try_element_at(rates, cost_sign(c)), F.lit(1.0))


def glob_match(c: Column | str, patterns: list[str]) -> Column:
    import fnmatch

    found = F.lit(False)
    for pattern in patterns:
        # \Z is Python's end of text; Java writes it \z
        found = found | col(c).rlike("^" + fnmatch.translate(pattern).replace(r"\Z", r"\z").replace("(?s:", "(?s:"))
    return found


def record_field(c: Column | str, n: int, fields: int = 4) -> Column:
    """Field n (from 1) of a comma record with so many fields, stripped; null for other lines."""
    parts = F.split(col(c), ",")
    return F.when(F.size(parts) == fields, stripped(F.element_at(parts, n)))


def answer_after_equals(c: Column | str) -> Column:
    """The part after the last =, stripped; null without one."""
    return F.when(F.contains(col(c), F.lit("=")), stripped(F.element_at(F.split(col(c), "="), -1)))


def screenshot_step(c: Column | str) -> Column:
    """(step, replay) of step_12_replay.png and step_12.png; step null for other names."""
    step = F.regexp_extract(col(c), r"step_(\d+)(_replay)?\.png", 1).try_cast("int")
    return F.struct(step.alias("step"), F.contains(col(c), F.lit("_replay.png")).alias("replay"))


def preference(c: Column | str) -> Column:
    """(key, value as JSON text) of a `user_pref("k", v);` line; key null for other lines."""
    pattern = r'^user_pref\("([^"]+)", (.*)\);$'
    return F.struct(filled(F.regexp_extract(col(c), pattern, 1)).alias("key"), filled(F.regexp_extract(col(c), pattern, 2)).alias("value"))


def with_affix(text: Column | str, name: Column | str, template: str, position: str = "start") -> Column:
    """The name, written into the template, before or after the text unless it is there already."""
    before, after = template.split("{name}")
    mark = F.concat(F.lit(before), col(name), F.lit(after))
    if position == "start":
        return F.when(F.startswith(col(text), mark), col(text)).otherwise(F.concat(mark, col(text)))
    return F.when(F.endswith(col(text), mark), col(text)).otherwise(F.concat(col(text), mark))


def cell_column(c: Column | str) -> Column:
    """AB12 -> 27: the column, from 0, of a cell reference (letters are digits of base 26)."""
    letters = F.upper(F.regexp_extract(col(c), r"^([A-Za-z]+)\d+$", 1))
    digits = F.filter(F.split(letters, ""), lambda x: x != "")
    value = F.aggregate(digits, F.lit(0), lambda acc, x: (acc * 26 + F.ascii(x) - 64).cast("int"))
    return F.when(letters != "", value - 1)


def cell_row(c: Column | str) -> Column:
    return F.regexp_extract(col(c), r"^[A-Za-z]+(\d+)$", 1).try_cast("int") - 1


def number_format(kind: Column | str, decimals: int = 2) -> Column:
    """Format strings of sheet cells."""
    tail = "0" + ("." + "0" * decimals if decimals else "")
    # Kind and format.
    formats = {
        "general": "General", "number": tail, "currency": f"[$$-409]#,##{tail}", "accounting": f"_-[$$-409]* #,##{tail}_-",
        "date": "YYYY-MM-DD", "time": "HH:MM:SS", "percentage": f"{tail}%", "fraction": "# ?/?", "scientific": f"{tail}E+00", "text": "@",
    }
    table = F.create_map(*[F.lit(x) for pair in formats.items() for x in pair])
    return F.try_element_at(table, F.lower(col(kind)))


def typed_cell(c: Column | str) -> Column:
    """(kind, number) of what is typed into a cell: formula, int, float or string."""
    whole, real = col(c).try_cast("long"), col(c).try_cast("double")
    kind = F.when(F.startswith(col(c), F.lit("=")), "formula").when(whole.isNotNull() & ~F.contains(col(c), F.lit(".")), "int").when(real.isNotNull(), "float").otherwise("string")
    return F.struct(kind.alias("kind"), F.when(kind != "formula", real).alias("number"))


def last_value_of(lines: Column | str, key: str, default: str) -> Column:
    """The value of the last `key=value` line of a configuration text."""
    values = F.filter(F.split(col(lines), "\n"), lambda x: F.startswith(stripped(x), F.lit(f"{key}=")))
    return F.coalesce(filled(stripped(F.substring_index(F.try_element_at(values, F.lit(-1)), "=", -1))), F.lit(default))


def key_combination(c: Column | str) -> Column:
    """ctrl+c -> [ctrl, c]; empty parts are dropped."""
    return F.filter(F.transform(F.split(col(c), r"\+"), stripped), lambda x: x != "")


def data_url(content: Column | str, kind: str = "image/png") -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.regexp_replace(F.base64(col(content)), "[\r\n]", ""))
