"""Recorded action code -> typed actions. Code is read as literals of Python's grammar and never evaluated."""

from __future__ import annotations

import ast
import json
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from stepweave.functions.text import col, key_combination

# The recorded screen, the screen of stored actions, and the grid of tool calls.
RECORDED, STORED, GRID = (1280, 800), (1280, 720), 999
# How single keys are shown, and how keys are written in combinations.
KEY_NAMES = {"enter": "Return", "return": "Return", "esc": "Escape", "escape": "Escape", "tab": "Tab", "space": "space", "backspace": "BackSpace", "delete": "Delete", "up": "Up", "down": "Down", "left": "Left", "right": "Right", "home": "Home", "end": "End", "pageup": "Page_Up", "pagedown": "Page_Down"}
COMBINATION_NAMES = {"control": "ctrl", "command": "cmd", "return": "enter", "escape": "esc"}

ACTION = StructType(
    [
        StructField("action", StringType()),
        StructField("coordinate", ArrayType(IntegerType())),
        StructField("start_coordinate", ArrayType(IntegerType())),
        StructField("text", StringType()),
        StructField("scroll_direction", StringType()),
        StructField("scroll_amount", IntegerType()),
        StructField("duration", DoubleType()),
    ]
)
_EMPTY = {"action": None, "coordinate": None, "start_coordinate": None, "text": None, "scroll_direction": None, "scroll_amount": None, "duration": None}


@dataclass
class Call:
    name: str
    args: list = field(default_factory=list)
    named: dict = field(default_factory=dict)

    def value(self, name: str, at: int):
        """A named argument, else the one at a position, else None."""
        return self.named[name] if name in self.named else self.args[at] if at < len(self.args) else None

    def point(self, first: int = 0) -> tuple | None:
        x, y = self.value("x", first), self.value("y", first + 1)
        return (x, y) if all(isinstance(v, (int, float)) for v in (x, y)) else None

    def amount(self, default: float = 0) -> float:
        for v in [*self.args[:1], *list(self.named.values())[:1]]:
            if isinstance(v, (int, float)):
                return float(v)
        return default


def calls_of(code: str, owners: tuple[str, ...] = ("pyautogui", "time")) -> list[Call]:
    """Calls of the owners with literal arguments, in order; a line that can't be read is left out."""

    def read(source: str) -> list[Call] | None:
        try:
            body = ast.parse(source).body
        except (SyntaxError, ValueError):
            return None
        found = []
        for node in body:
            call = node.value if isinstance(node, ast.Expr) else None
            if not (isinstance(call, ast.Call) and isinstance(call.func, ast.Attribute) and isinstance(call.func.value, ast.Name) and call.func.value.id in owners):
                continue
            try:
                found.append(Call(call.func.attr, [ast.literal_eval(a) for a in call.args], {k.arg: ast.literal_eval(k.value) for k in call.keywords if k.arg}))
            except (ValueError, TypeError):
                continue
        return found

    whole = read(code.strip())
    if whole is not None:
        return whole
    return [c for line in code.replace(";", "\n").splitlines() for c in read(line.strip()) or []]


def unwrapped(code: str) -> str:
    """The `action` of a container written as a dict, else the code itself."""
    if code.strip().startswith("{"):
        for read in (ast.literal_eval, json.loads):
            try:
                found = read(code.strip())
            except (ValueError, SyntaxError):
                continue
            if isinstance(found, dict) and isinstance(found.get("action"), str):
                return found["action"]
    return code


def scaled(point: tuple, screen: tuple = RECORDED, to: tuple = STORED) -> list[int]:
    """To another screen; halves round to even."""
    return [round(float(v) * b / a) for v, a, b in zip(point, screen, to, strict=True)]


def key_text(keys: list) -> str:
    names = [str(k).strip().strip("'\"") for k in keys]
    if len(names) == 1:
        low = names[0].lower()
        return KEY_NAMES.get(low, low if len(low) == 1 else names[0])
    return "+".join(COMBINATION_NAMES.get(n.lower(), n.lower()) for n in names)


def held_combination(calls: list[Call]) -> list | None:
    """Keys that are down when another is pressed, and that one."""
    down: list = []
    for c in calls:
        if not c.args:
            continue
        if c.name == "keyDown" and c.args[0] not in down:
            down.append(c.args[0])
        elif c.name == "press" and down:
            return [*down, c.args[0]]
        elif c.name == "keyUp" and c.args[0] in down:
            down.remove(c.args[0])
    return None


def _pastes(calls: list[Call]) -> bool:
    hot = any(c.name == "hotkey" and {"ctrl", "v"} <= {str(a).lower() for a in c.args} for c in calls)
    held = [str(k).lower() for k in held_combination(calls) or []]
    return hot or (len(held) > 1 and held[-1] == "v" and bool({"ctrl", "control"} & set(held[:-1])))


def _last(calls: list[Call], *names: str) -> Call | None:
    return next((c for c in reversed(calls) if c.name in names), None)


def _drag(calls, _):
    at = next((i for i, c in enumerate(calls) if c.name in ("dragTo", "dragRel")), None)
    if at is None:
        return None
    call = calls[at]
    moved = next((c.point() for c in reversed(calls[:at]) if c.name == "moveTo" and c.point()), None)
    start = scaled(moved) if moved else None
    if call.name == "dragTo":
        end = scaled(call.point()) if call.point() else None
    else:
        by = (call.value("xOffset", 0), call.value("yOffset", 1))
        end = [a + b for a, b in zip(start, scaled(by), strict=True)] if start and None not in by else None
    start = start or end
    return {"action": "left_click_drag", "start_coordinate": start, "coordinate": end} if start and end else None


def _scroll(calls, _):
    for name, (more, less) in {"scroll": ("up", "down"), "hscroll": ("right", "left")}.items():
        call = _last(calls, name)
        if call and call.amount():
            point = call.point(1)
            where = scaled(point) if point else [STORED[0] // 2, STORED[1] // 2]
            return {"action": "scroll", "coordinate": where, "scroll_direction": more if call.amount() > 0 else less, "scroll_amount": abs(round(call.amount()))}
    return None


def _type(calls, clipboard):
    call = next((c for c in calls if c.name in ("typewrite", "write")), None)
    if call and call.args and isinstance(call.args[0], str):
        return {"action": "type", "text": call.args[0]}
    if clipboard and (not calls or _pastes(calls)):
        return {"action": "type", "text": clipboard}
    pressed = [c.args[0] if c.args else None for c in calls if c.name == "press"]
    if calls and len(pressed) == len(calls):
        letters = ["\n" if str(k).lower() in ("enter", "return") else "\t" if k == "tab" else " " if k == "space" else k for k in pressed]
        if len(letters) > 1 and all(isinstance(k, str) and len(k) == 1 for k in letters) and len(set(pressed)) > 1:
            return {"action": "type", "text": "".join(letters)}
    return None


def _click(calls, _):
    call = _last(calls, "click", "doubleClick", "tripleClick", "rightClick", "middleClick")
    if not call or not call.point():
        return None
    times, button = call.named.get("clicks") or 1, call.named.get("button", "left")
    if call.name == "doubleClick" or times == 2:
        kind = "double_click"
    elif call.name == "tripleClick" or times >= 3:
        kind = "triple_click"
    else:
        kind = {"rightClick": "right_click", "middleClick": "middle_click"}.get(call.name, f"{button}_click")
    return {"action": kind, "coordinate": scaled(call.point())}


def _move(calls, _):
    return {"action": "mouse_move", "coordinate": scaled(calls[0].point())} if len(calls) == 1 and calls[0].name in ("moveTo", "moveRel") and calls[0].point() else None


def _key(calls, _):
    hot = _last(calls, "hotkey")
    downs = [c.args[0] for c in calls if c.name == "keyDown" and c.args]
    presses = [c.args[0] for c in calls if c.name == "press" and c.args]
    keys = (hot.args if hot and hot.args else None) or held_combination(calls) or downs or (presses[:1] if len(set(map(str, presses))) == 1 else None)
    return {"action": "key", "text": key_text(list(keys))} if keys else None


def _wait(calls, _):
    call = next((c for c in calls if c.name in ("sleep", "pause")), None)
    return {"action": "wait", "duration": float(max(1, round(call.amount(1))))} if call else None


#: The first that applies decides.
_ORDER = (_drag, _scroll, _type, _click, _move, _key, _wait)


def parse_action(code: str | None) -> dict | None:
    """One typed action of a code string; None where there is none (and for DONE and FAIL)."""
    if not code or not code.strip():
        return None
    code = unwrapped(code)
    word = code.strip().upper()
    if word in ("DONE", "FAIL"):
        return None
    if word == "WAIT":
        return _EMPTY | {"action": "wait", "duration": 1.0}
    copied = [c.args[0] for c in calls_of(code, ("pyperclip",)) if c.name == "copy" and c.args]
    calls = calls_of(code)
    for build in _ORDER:
        found = build(calls, copied[-1] if copied else None)
        if found:
            return _EMPTY | found
    return None


def parse_human_action(code: str | None) -> dict | None:
    """The first statement alone; points within 0..1 are shares of the stored screen."""
    calls = calls_of((code or "").strip().replace(";", "\n").split("\n")[0])
    if not calls:
        return None
    call = calls[0]
    point = call.point()
    if point is not None:
        unit = all(0 <= v <= 1 for v in point)
        point = [round(v * s) for v, s in zip(point, STORED if unit else (1, 1), strict=True)]
    name, button, times = call.name.lower(), str(call.named.get("button", "left")), call.named.get("clicks", 1)
    if name == "sleep":
        found = {"action": "wait", "duration": call.amount(1.0)}
    elif name in ("click", "doubleclick", "tripleclick"):
        kind = "double_click" if name == "doubleclick" or times == 2 else "triple_click" if name == "tripleclick" or times == 3 else f"{button}_click"
        found = {"action": kind, "coordinate": point}
    elif name in ("moveto", "moverel"):
        found = {"action": "mouse_move", "coordinate": point} if point else None
    elif name in ("dragto", "dragrel"):
        found = {"action": "left_click_drag", "coordinate": point, "duration": call.named.get("duration")}
    elif name in ("typewrite", "write"):
        found = {"action": "type", "text": str(call.value("message", 0) or call.named.get("text", ""))}
    elif name in ("hotkey", "keydown", "keyup", "press"):
        keys = call.named.get("keys", call.args)
        found = {"action": "key", "text": "+".join(str(k) for k in ([keys] if isinstance(keys, str) else keys))}
    elif name == "scroll":
        found = {"action": "scroll", "scroll_amount": abs(int(call.amount())), "scroll_direction": "down" if call.amount() < 0 else "up"}
    else:
        found = None
    return _EMPTY | found if found else None


def _frame(found: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(found, columns=list(_EMPTY), dtype=object)
    return out.astype({"scroll_amount": "Int32", "duration": "float64"})


@F.pandas_udf(ACTION)
def typed_action(code: pd.Series) -> pd.DataFrame:
    return _frame([parse_action(c) or _EMPTY for c in code])


@F.pandas_udf(ACTION)
def typed_human_action(code: pd.Series) -> pd.DataFrame:
    return _frame([parse_human_action(c) or _EMPTY for c in code])


# columns alone


def scale_axis(c: Column | str, size: float, to: float = GRID) -> Column:
    """Clamped to the screen, put on a grid, halves to even."""
    held = F.greatest(F.lit(0.0), F.least(F.lit(float(size)), col(c).cast("double")))
    return F.greatest(F.lit(0), F.least(F.lit(int(to)), F.bround(held / size * to).cast("int")))


def rescale_axis(c: Column | str, size: float, to: float) -> Column:
    return F.bround(col(c).cast("double") * (to / size)).cast("int")


def grid_point(point: Column | str, screen: tuple = STORED) -> Column:
    p = col(point)
    return F.when(F.size(p) == 2, F.array(scale_axis(p[0], screen[0]), scale_axis(p[1], screen[1])))


def end_status(status: Column | str) -> Column:
    return F.when(F.lower(col(status)).isin("fail", "failure"), "failure").otherwise("success")


def tool_call(action: Column | str, terminal: Column | None = None, status: Column | None = None) -> Column:
    """{name, arguments} as JSON of a typed action; null without an action."""
    a = col(action)
    kind = F.when(a["action"] == "triple_click", "double_click").otherwise(a["action"])
    place = grid_point(F.coalesce(a["coordinate"], F.when(kind != "left_click_drag", a["start_coordinate"])))
    mouse = kind.isin("left_click", "right_click", "middle_click", "double_click", "mouse_move", "left_click_drag")
    amount = F.coalesce(a["scroll_amount"], F.lit(0))
    pixels = F.when(a["scroll_direction"] == "down", -F.abs(amount)).when(a["scroll_direction"] == "up", F.abs(amount)).otherwise(amount)
    arguments = F.struct(
        kind.alias("action"),
        F.when(mouse, place).alias("coordinate"),
        F.when(kind == "left_click_drag", grid_point(a["start_coordinate"])).alias("start_coordinate"),
        F.when(kind == "left_click_drag", F.coalesce(a["duration"], F.lit(0.5))).alias("duration"),
        F.when(kind == "type", F.coalesce(a["text"], F.lit(""))).alias("text"),
        F.when(kind == "key", key_combination(F.coalesce(a["text"], F.lit("")))).alias("keys"),
        F.when(kind == "scroll", pixels).alias("pixels"),
        F.when(kind == "wait", a["duration"]).alias("time"),
    )
    out = F.when(kind.isNotNull(), F.to_json(F.struct(F.lit("computer_use").alias("name"), arguments.alias("arguments"))))
    if terminal is not None:
        ended = F.struct(F.lit("terminate").alias("action"), end_status(status).alias("status"))
        out = F.when(F.coalesce(terminal, F.lit(False)), F.to_json(F.struct(F.lit("computer_use").alias("name"), ended.alias("arguments")))).otherwise(out)
    return out


def projected(value: Column | str, kind: str, size: float, resized: float | None = None) -> Column:
    """A model's coordinate on one axis -> pixels: relative (0..1), absolute, resized, or grid (0..1000)."""
    v = col(value).cast("double")
    out = {"relative": lambda: v * size, "absolute": lambda: v, "resized": lambda: v / resized * size, "grid": lambda: v / 1000 * size}[kind]()
    return out.cast("int")


def box_convert(box: Column | str, source: str, target: str, size: tuple[float, float], resized: tuple[float, float] | None = None) -> Column:
    """A box or point between absolute pixels, resized pixels, shares, a 1000 grid and a 1024 grid, cut to whole numbers."""
    resized = resized or size
    spans = {"absolute": size, "resized": resized, "share": (1.0, 1.0), "grid1000": (1000.0, 1000.0), "grid1024": (1024.0, 1024.0)}
    a, b = spans[source], spans[target]

    def one(x, i):
        ratio = F.when(i % 2 == 0, b[0] / a[0]).otherwise(b[1] / a[1])
        return x.cast("double") * ratio

    out = F.transform(col(box), one)
    return out if target == "share" else F.transform(out, lambda x: x.cast("int"))


def smart_size(height: Column | str, width: Column | str, factor: int = 28, least: int = 56 * 56, most: int = 14 * 14 * 4 * 1280) -> Column:
    """(height, width), multiples of the factor, with the area between the bounds and about the same shape."""
    h, w = col(height).cast("double"), col(width).cast("double")
    near = lambda x: F.greatest(F.lit(factor), (F.bround(x / factor) * factor).cast("int"))
    big, small = F.sqrt(h * w / most), F.sqrt(least / (h * w))
    down = lambda x: (F.floor(x / big / factor) * factor).cast("int")
    up = lambda x: (F.ceil(x * small / factor) * factor).cast("int")
    area = near(h) * near(w)
    fit = lambda x: F.when(area > most, down(x)).when(area < least, up(x)).otherwise(near(x))
    return F.struct(fit(h).alias("height"), fit(w).alias("width"))


def similar_actions(a: Column | str, b: Column | str, ignored: tuple[str, ...] = ("description", "reason", "element_description")) -> Column:
    """Maps equal but for descriptive keys."""
    own = lambda m: F.array_sort(F.map_entries(F.map_filter(col(m), lambda k, v: ~k.isin(*ignored))))
    return own(a) == own(b)
