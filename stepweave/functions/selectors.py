"""Elements of XML texts by XPath or CSS selectors, as Columns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from stepweave.functions.similarity import indel_ratio
from stepweave.functions.text import col

# Prefixes that accessibility trees declare.
PREFIXES = ("st", "attr", "cp", "doc", "docattr", "txt", "val", "act", "class", "role", "id")

_NAME = r"[A-Za-z_][\w.-]*"
_STEP = re.compile(rf"\s*(?P<join>[>+~]|\s|^)\s*(?P<tag>(?:{_NAME}\|)?(?:{_NAME}|\*))?(?P<rest>(?:\#[\w-]+|\.[\w-]+|\[[^\]]*\]|:[a-z-]+(?:\([^)]*\))?)*)")
_PART = re.compile(r"#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[(?P<attr>[^\]]*)\]|:(?P<pseudo>[a-z-]+)(?:\((?P<arg>[^)]*)\))?")
_ATTRIBUTE = re.compile(rf"\s*(?P<name>(?:{_NAME}\|)?{_NAME})\s*(?:(?P<how>[~|^$*]?=)\s*(?P<quote>[\"']?)(?P<value>.*?)(?P=quote))?\s*$")


def _quoted(value: str) -> str:
    return f"'{value}'" if "'" not in value else f'"{value}"'


def _attribute(name: str) -> str:
    return f"@*[name()='{name.replace('|', ':')}']" if "|" in name else f"@{name}"


def _condition(part: re.Match) -> str:
    if part["id"]:
        return f"@id={_quoted(part['id'])}"
    if part["cls"]:
        return f"contains(concat(' ', normalize-space(@class), ' '), ' {part['cls']} ')"
    if part["pseudo"]:
        kinds = {"first-child": "not(preceding-sibling::*)", "last-child": "not(following-sibling::*)", "only-child": "count(../*)=1", "empty": "not(node())"}
        if part["pseudo"] in kinds:
            return kinds[part["pseudo"]]
        if part["pseudo"] == "nth-child" and (part["arg"] or "").strip().isdigit():
            return f"count(preceding-sibling::*)={int(part['arg']) - 1}"
        if part["pseudo"] == "not":
            return f"not({' and '.join(_condition(p) for p in _PART.finditer(part['arg']))})"
        raise ValueError(f"no selector :{part['pseudo']}")
    found = _ATTRIBUTE.match(part["attr"])
    if not found:
        raise ValueError(f"no selector [{part['attr']}]")
    at, how = _attribute(found["name"]), found["how"]
    if not how:
        return at
    v = _quoted(found["value"])
    tail = f"substring({at}, string-length({at}) - {len(found['value']) - 1})={v}"
    return {"=": f"{at}={v}", "^=": f"starts-with({at}, {v})", "$=": tail, "*=": f"contains({at}, {v})", "~=": f"contains(concat(' ', normalize-space({at}), ' '), concat(' ', {v}, ' '))", "|=": f"({at}={v} or starts-with({at}, concat({v}, '-')))"}[how]


def css_to_xpath(selector: str) -> str:
    """A selector of tags, #id, .class, attributes, child, sibling and descendant steps, and simple positions; commas unite."""
    paths = []
    for one in selector.split(","):
        one, path, at = one.strip(), "", 0
        while at < len(one):
            step = _STEP.match(one, at)
            if not step or step.end() == at or not (step["tag"] or step["rest"]):
                raise ValueError(f"no selector {one!r}")
            tag = step["tag"] or "*"
            name = f"*[name()='{tag.replace('|', ':')}']" if "|" in tag else tag
            join = (step["join"] or "").strip()
            if join == "+":
                name = f"*[1][self::{name}]" if "|" not in tag else f"*[1][name()='{tag.replace('|', ':')}']"
            path += {"": "//", ">": "/", "+": "/following-sibling::", "~": "/following-sibling::"}[join] + name
            path += "".join(f"[{_condition(p)}]" for p in _PART.finditer(step["rest"]))
            at = step.end()
        paths.append(path)
    return " | ".join(paths)


def plain_xpath(xpath: str) -> str:
    """Prefixed names as tests of the whole name, as no prefix is declared to the reader of expressions."""
    names = "|".join(PREFIXES)
    xpath = re.sub(rf"@({names}):([\w-]+)", r"@*[name()='\1:\2']", xpath)
    return re.sub(rf"(?<![\w:'@-])({names}):(?!:)([\w-]+)", r"*[name()='\1:\2']", xpath)


def elements(xml: Column | str, xpath: str) -> Column:
    """How many elements an expression selects."""
    return F.xpath_int(col(xml), F.lit(f"count({plain_xpath(xpath)})"))


def element_texts(xml: Column | str, xpath: str) -> Column:
    """The selected elements' texts that stand before their first child."""
    return F.xpath(col(xml), F.lit(" | ".join(f"{p.strip()}/node()[1][self::text()]" for p in plain_xpath(xpath).split(" | "))))


@F.pandas_udf(DoubleType())
def best_ratio(texts: pd.Series, wanted: pd.Series) -> pd.Series:
    """The best fuzzy ratio, 0 to 1, of some text."""
    return pd.Series([max((indel_ratio(t, w) / 100 for t in (x if x is not None else []) if t is not None), default=0.0) for x, w in zip(texts, wanted, strict=True)])


def tree_score(xml: Column | str, rules: list[dict]) -> Column:
    """Rules with an `xpath` or `selectors`, and perhaps a `text` (`exact` or not): the product of their best scores, 0 where nothing is selected."""
    out = F.lit(1.0)
    for r in rules:
        if "xpath" not in r and "selectors" not in r:
            raise ValueError("a rule needs an xpath or selectors")
        path = r["xpath"] if "xpath" in r else css_to_xpath(", ".join(r["selectors"]))
        found = F.when(elements(xml, path) > 0, 1.0).otherwise(0.0)
        if "text" in r:
            texts = element_texts(xml, path)
            found = F.when(F.array_contains(texts, r["text"]), 1.0).otherwise(0.0) if r.get("exact", True) else best_ratio(texts, F.lit(r["text"]))
        out = out * found
    return out
