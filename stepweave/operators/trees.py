"""Accessibility trees: XML text -> node rows, filters over them, linear forms, and overlap dedup."""

from __future__ import annotations

import ast
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

# Bounds of a capture.
MAX_DEPTH, MAX_WIDTH, MAX_NODES = 50, 1024, 5000
# Tags of nodes that may be kept, by ending, by beginning, and whole.
TAG_ENDS = ["item", "button", "heading", "label", "scrollbar", "searchbox", "textbox", "link", "tabelement", "textfield", "textarea", "menu"]
TAG_STARTS = ["document"]
TAGS = ["alert", "canvas", "check-box", "combo-box", "entry", "icon", "image", "paragraph", "scroll-bar", "section", "slider", "static", "table-cell", "terminal", "text", "netuiribbontab", "start", "trayclockwclass", "traydummysearchcontrol", "uiimage", "uiproperty", "uiribboncommandbar"]
STATES = ["enabled", "editable", "expandable", "checkable"]

_KINDS = {"depth": IntegerType(), "active": BooleanType(), "states": ArrayType(StringType()), "image": BooleanType()} | {c: IntegerType() for c in "xywh"}
NODE = ArrayType(StructType([StructField(n, _KINDS.get(n, StringType())) for n in ("path", "depth", "tag", "name", "text", "cls", "description", "app", "active", "states", "image", "x", "y", "w", "h")]))


def _pair(value: str | None) -> tuple[int, int]:
    try:
        found = ast.literal_eval(value) if value else (-1, -1)
        return int(found[0]), int(found[1])
    except (ValueError, SyntaxError, TypeError, IndexError):
        return -1, -1


def nodes_of(xml: str | None) -> list[dict]:
    """Nodes in document order, within the bounds; attributes are known by their local names."""
    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError:
        return []
    found, waits = [], [(root, "0", 0, "", False)]
    while waits and len(found) < MAX_NODES:
        node, path, depth, app, active = waits.pop()
        own = {k.rpartition("}")[2]: v for k, v in node.attrib.items()}
        tag = node.tag.rpartition("}")[2]
        if tag == "application":
            app, active = own.get("name", ""), own.get("active", "false") == "true"
        (x, y), (w, h) = _pair(own.get("screencoord")), _pair(own.get("size"))
        states = sorted(k for k, v in own.items() if v == "true")
        active = active or (tag == "frame" and "active" in states)
        found.append({"path": path, "depth": depth, "tag": tag, "name": own.get("name", ""), "text": node.text or "", "cls": own.get("class", ""), "description": own.get("description", ""), "app": app, "active": active, "states": states, "image": own.get("image") == "true", "x": x, "y": y, "w": w, "h": h})
        if depth < MAX_DEPTH:
            waits += [(child, f"{path}.{i}", depth + 1, app, active) for i, child in reversed(list(enumerate(list(node)[:MAX_WIDTH])))]
    return found


@F.pandas_udf(NODE)
def tree_nodes(xml: pd.Series) -> pd.Series:
    return xml.map(nodes_of)


def flatten(trees: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, at, node fields)."""
    return trees.select(key, F.posexplode(tree_nodes(xml)).alias("at", "n")).select(key, "at", "n.*")


def has_state(name: str) -> Column:
    return F.array_contains("states", name)


def kept_node(platform: str = "ubuntu", images: bool = False, interactive: bool = True) -> Column:
    """Nodes an agent can see and use; interactive=False is the relaxed form."""
    tag = F.col("tag").isin(TAGS)
    for end in TAG_ENDS:
        tag = tag | F.endswith(F.col("tag"), F.lit(end))
    for start in TAG_STARTS:
        tag = tag | F.startswith(F.col("tag"), F.lit(start))
    seen = has_state("visible") & (has_state("showing") if platform == "ubuntu" else F.lit(True))
    used = F.arrays_overlap("states", F.array(*[F.lit(s) for s in STATES])) if interactive else F.lit(True)
    told = (F.col("name") != "") | (F.length("text") > 0) | (F.lit(images) & F.col("image"))
    return tag & seen & used & told & placed()


def placed() -> Column:
    return (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("w") > 0) & (F.col("h") > 0)


def active_applications(nodes: DataFrame, key: str, shell: str = "gnome-shell", default: tuple[str, ...] = ("gnome-shell", "gjs")) -> DataFrame:
    """(key, apps): the active ones and the shell, or the default two where none is active."""
    apps = nodes.groupBy(key).agg(F.array_sort(F.collect_set(F.when(F.col("active"), F.col("app")))).alias("apps"))
    some = F.array_sort(F.array_union("apps", F.array(F.lit(shell))))
    return apps.select(key, F.when(F.size("apps") > 0, some).otherwise(F.array(*[F.lit(d) for d in default])).alias("apps"))


def linear(nodes: DataFrame, key: str) -> DataFrame:
    """Tab-separated lines under a header; texts with quotes are quoted, their quotes doubled."""
    text = F.when(F.col("text") == "", F.lit('""')).when(F.contains("text", F.lit('"')), F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col("text"))
    point = lambda a, b: F.format_string("(%d, %d)", a, b)
    line = F.concat_ws("\t", "tag", "name", text, "cls", "description", point("x", "y"), point("w", "h"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("at", line.alias("l")))), lambda s: s["l"])
    header = "tag\tname\ttext\tclass\tdescription\tposition (top-left x&y)\tsize (w&h)"
    return nodes.groupBy(key).agg(F.concat(F.lit(header + "\n"), F.array_join(lines, "\n")).alias("tree"))


def trimmed(tree: Column | str, lines: int, mark: str = "[...]") -> Column:
    parts = F.split(F.col(tree) if isinstance(tree, str) else tree, "\n")
    return F.when(F.size(parts) > lines, F.concat(F.array_join(F.slice(parts, 1, lines), "\n"), F.lit(f"\n{mark}"))).otherwise(F.array_join(parts, "\n"))


def iou(a: str, b: str) -> Column:
    """Overlap of two boxes (structs of x, y, w, h) over their union; 0 without an area."""
    p, q = F.col(a), F.col(b)
    side = lambda at, size: F.greatest(F.lit(0), F.least(p[at] + p[size], q[at] + q[size]) - F.greatest(p[at], q[at]))
    both = side("x", "w") * side("y", "h")
    union = p["w"] * p["h"] + q["w"] * q["h"] - both
    return F.when(union > 0, both / union).otherwise(0.0)


def overlapping_pairs(nodes: DataFrame, key: str, order: str, norm: str, cell: int = 64, least: float = 0.2) -> DataFrame:
    """(key, first, second, iou) of boxes with one text that overlap; of boxes that share a place in the order, the largest.

    Boxes meet by key, text and a grid cell that both touch. A pair counts in one cell alone, that of the top-left corner of what
    they share, so that only pairs which overlap enough go on, once each."""
    touched = lambda at, size: F.sequence(F.floor(F.col(at) / cell), F.floor((F.col(at) + F.greatest(F.col(size), F.lit(1)) - 1) / cell))
    gridded = nodes.select(key, norm, F.col(order).alias("o"), *"xywh", F.explode(touched("x", "w")).alias("gx"), touched("y", "h").alias("gys")).withColumn("gy", F.explode("gys")).drop("gys")
    a = gridded.withColumnsRenamed({"o": "first", **{c: f"{c}1" for c in "xywh"}})
    b = gridded.withColumnsRenamed({"o": "second", **{c: f"{c}2" for c in "xywh"}})
    side = lambda at, size: F.least(F.col(f"{at}1") + F.col(f"{size}1"), F.col(f"{at}2") + F.col(f"{size}2")) - F.greatest(f"{at}1", f"{at}2")
    corner = lambda at: F.floor(F.greatest(f"{at}1", f"{at}2") / cell)
    here = (F.col("first") < F.col("second")) & (corner("x") == F.col("gx")) & (corner("y") == F.col("gy")) & (side("x", "w") > 0) & (side("y", "h") > 0)
    pairs = a.join(b, [key, norm, "gx", "gy"]).where(here)
    shared = side("x", "w") * side("y", "h")
    ratio = shared / (F.col("w1") * F.col("h1") + F.col("w2") * F.col("h2") - shared)
    return pairs.select(key, "first", "second", ratio.alias("iou")).where(F.col("iou") > least).groupBy(key, "first", "second").agg(F.max("iou").alias("iou"))


def drop_overlaps(nodes: DataFrame, key: str, order: str, norm: str, least: float = 0.2) -> DataFrame:
    """Greedy, in order: a node goes if a kept earlier one has its text and overlaps it; a node that went removes none."""
    pairs = overlapping_pairs(nodes, key, order, norm, least=least)

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        gone: set = set()
        for a, b in sorted(zip(pdf["first"], pdf["second"], strict=True)):
            if a not in gone:
                gone.add(b)
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(gone), "o": sorted(gone)})

    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema.fields}
    gone = pairs.groupBy(key).applyInPandas(greedy, f"{key} {kinds[key]}, o {kinds[order]}")
    return nodes.join(gone.withColumnRenamed("o", order), [key, order], "left_anti")
