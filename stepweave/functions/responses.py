"""Model responses -> actions: tool calls, code blocks, thought and action lines, plans."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

from stepweave.functions.actions import GRID, calls_of
from stepweave.functions.text import code_blocks, col, stripped

# Words that end or hold a run, and the calls that tool actions become.
COMMANDS = ("WAIT", "DONE", "FAIL")
MOUSE_CALLS = {"left_click": "click", "right_click": "rightClick", "middle_click": "middleClick", "double_click": "doubleClick", "mouse_move": "moveTo", "left_click_drag": "dragTo"}


def _objects(text: str) -> list[dict]:
    """JSON objects between tool-call marks, or alone on a line, in order."""
    found = []
    for marked, line in re.findall(r"<tool_call>(.*?)(?:</tool_call>|\Z)|^[ \t]*(\{.*\})[ \t]*$", text, re.S | re.M):
        try:
            value = json.loads(marked or line)
        except ValueError:
            continue
        if isinstance(value, dict):
            found.append(value)
    return found


def tool_code(call: dict, screen: tuple[int, int] | None = None, seen: tuple[int, int] | None = None) -> str | None:
    """The code line of a computer_use call. Points are on the grid, or pixels of `seen` if it is given."""
    args = call.get("arguments")
    if call.get("name") != "computer_use" or not isinstance(args, dict) or "action" not in args:
        return None
    kind = args["action"]
    if kind in MOUSE_CALLS:
        name = MOUSE_CALLS[kind]
        if "coordinate" not in args:
            return f"pyautogui.{name}({'0, 0' if kind in ('mouse_move', 'left_click_drag') else ''})"
        span = seen or (GRID, GRID)
        x, y = (int(v * (s / m)) if screen else int(v) for v, s, m in zip(args["coordinate"], screen or span, span, strict=True))
        return f"pyautogui.{name}({x}, {y}{f', duration={args.get('duration', 0.5)}' if kind == 'left_click_drag' else ''})"
    if kind == "key":
        keys = [re.sub(r"^(keys=)?\[?['\"]?|['\"]?\]?$", "", k).strip() if isinstance(k, str) else k for k in args.get("keys", [])]
        return f"pyautogui.{'hotkey' if len(keys) > 1 else 'press'}({', '.join(repr(str(k)) for k in keys)})"
    return {"type": lambda: f"pyautogui.typewrite({args.get('text', '')!r})", "scroll": lambda: f"pyautogui.scroll({args.get('pixels', 0)})", "wait": lambda: "WAIT", "terminate": lambda: "DONE"}.get(kind, lambda: None)()


def drag_codes(call: dict, screen: tuple[int, int] | None, seen: tuple[int, int] | None) -> list[str]:
    """A drag that may say where it starts: a move there, and the drag to its end (to the start, if it names no end)."""
    args = call["arguments"]
    is_point = lambda p: isinstance(p, list | tuple) and len(p) == 2
    start, end = args.get("start_coordinate"), args.get("coordinate", args.get("start_coordinate"))
    moves = [tool_code({**call, "arguments": {"action": "mouse_move", "coordinate": start}}, screen, seen)] if is_point(start) else []
    drag = {k: v for k, v in args.items() if k != "coordinate"} | ({"coordinate": end} if is_point(end) else {})
    return [*moves, tool_code({**call, "arguments": drag}, screen, seen)]


def parse_tool_response(response: str | None, screen: tuple[int, int] | None = None, seen: tuple[int, int] | None = None, tuned: bool = False) -> tuple[str, list[str]]:
    """(instruction, code lines): the first `Action:` line, else the kind of the first call.

    tuned: a `Reasoning:` line is an instruction too, and drags are those of drag_codes."""
    text, codes = response or "", []
    for call in _objects(text):
        args = call.get("arguments")
        drags = tuned and call.get("name") == "computer_use" and isinstance(args, dict) and args.get("action") == "left_click_drag"
        codes += [c for c in (drag_codes(call, screen, seen) if drags else [tool_code(call, screen, seen)]) if c]
    told = re.search(rf"^[ \t]*(?:action{'|reasoning' if tuned else ''}):[ \t]*(.*?)[ \t]*$", text, re.I | re.M)
    if told and told[1]:
        return told[1], codes
    return (f"Performing {re.sub(r'^pyautogui.|[(].*', '', codes[0], flags=re.S)} action" if codes else ""), codes


def parse_thought(text: str | None, factor: float = 1000.0) -> list[dict]:
    """Thought, reflection, and each call after the last `Action:`; boxes become shares (x1, y1, x2, y2)."""
    text = (text or "").strip()
    if "Action:" not in text:
        return []
    reflection = re.search(r"Reflection: (.+?)(?=\s*Action_Summary:)", text, re.S)
    thought = re.search(r"(?:Action_Summary|Thought): (.+?)(?=\s*Action:|\Z)", text, re.S)
    found = []
    for part in text.rpartition("Action:")[2].split("\n\n"):
        calls = calls_of("agent." + part.strip().replace("\n", "\\n"), ("agent",))
        for call in calls:
            inputs = {}
            for name, value in call.named.items():
                if value in ("", None):
                    continue
                value = str(value).lstrip()
                if name in ("start_box", "end_box"):
                    numbers = [float(x) / factor for x in re.findall(r"-?\d+(?:\.\d+)?", value)]
                    value = str(numbers * 2 if len(numbers) == 2 else numbers)
                inputs[name] = value
            found.append({"reflection": reflection and reflection[1].strip(), "thought": thought and thought[1].strip(), "action_type": call.name, "action_inputs": inputs})
    return found


def parse_json_actions(text: str | None) -> list[str]:
    """JSON texts of fenced actions (of the whole text without a fence); commands stand for themselves."""
    text = text or ""
    if text.strip() in COMMANDS:
        return [text.strip()]
    bodies = re.findall(r"```json\s+(.*?)\s+```", text, re.S) or re.findall(r"```\s+(.*?)\s+```", text, re.S) or [text]
    found = []
    for body in bodies:
        try:
            found.append(json.dumps(json.loads(body)))
        except ValueError:
            return []
    return found


def parse_dag(text: str | None) -> dict | None:
    """{nodes, edges} of a tagged, fenced or bare plan."""
    text = text or ""
    for pattern in (r"<json>(.*?)</json>", r"```(?:json)?\s*(.*?)```", r"(.*)"):
        for body in re.findall(pattern, text, re.S):
            try:
                value = json.loads(body)
            except ValueError:
                continue
            value = value.get("dag", value) if isinstance(value, dict) else None
            if isinstance(value, dict) and {"nodes", "edges"} <= set(value):
                return {"nodes": value["nodes"], "edges": value["edges"]}
    return None


def fix_less_than(code: str) -> str:
    """Typing < as a key combination, wherever a press or a written text has it."""
    hot = 'pyautogui.hotkey("shift", ",")'
    code = re.sub(r"""pyautogui\.press\((["'])(?:<|\\u003c)\1\)""", lambda m: hot, code)

    def written(m: re.Match) -> str:
        try:
            text = ast.literal_eval(m[1] + m[2] + m[1])
        except (ValueError, SyntaxError):
            text = m[2]
        if "<" not in text:
            return m[0]
        pieces = [f"pyautogui.typewrite({m[1]}{p}{m[1]})" if p else "" for p in text.split("<")]
        return "; ".join(x for i, p in enumerate(pieces) for x in ([hot] if i else []) + [p] if x)

    return re.sub(r"""pyautogui\.typewrite\((["'])(.*?)\1\)""", written, code)


_RESPONSE = StructType([StructField("instruction", StringType()), StructField("codes", ArrayType(StringType()))])
_THOUGHT = ArrayType(StructType([StructField("reflection", StringType()), StructField("thought", StringType()), StructField("action_type", StringType()), StructField("action_inputs", MapType(StringType(), StringType()))]))


@F.pandas_udf(_RESPONSE)
def tool_response(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_tool_response(t) for t in text], columns=["instruction", "codes"])


@F.pandas_udf(_RESPONSE)
def tuned_response(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_tool_response(t, tuned=True) for t in text], columns=["instruction", "codes"])


@F.pandas_udf(_THOUGHT)
def thought_actions(text: pd.Series) -> pd.Series:
    return text.map(parse_thought)


@F.pandas_udf(ArrayType(StringType()))
def json_actions(text: pd.Series) -> pd.Series:
    return text.map(parse_json_actions)


@F.pandas_udf(StringType())
def without_less_than(code: pd.Series) -> pd.Series:
    return code.map(lambda c: None if c is None else fix_less_than(c))


def code_actions(text: Column | str) -> Column:
    """Codes of fenced blocks; a command on a block's last line is an action of its own; a bare command stands for itself."""
    lined = F.regexp_replace(col(text), r"\s*;\s*", "\n")
    commands = [F.lit(c) for c in COMMANDS]

    def split(block):
        lines = F.split(block, "\n")
        last = F.element_at(lines, -1)
        body = F.array_join(F.slice(lines, F.lit(1), F.size(lines) - 1), "\n")
        return F.when(last.isin(*commands), F.filter(F.array(body, last), lambda x: x != "")).otherwise(F.array(block))

    return F.when(stripped(lined).isin(*commands), F.array(stripped(lined))).otherwise(F.flatten(F.transform(code_blocks(lined), split)))


def with_tags(codes: Column | str, boxes: Column | str) -> Column:
    """Before each code that is no command: tag_1=(x, y), ... the centres of the boxes (x, y, w, h)."""
    centre = lambda b, i: F.concat(F.lit("tag_"), (i + 1).cast("string"), F.lit("=("), F.floor(b["x"] + F.floor(b["w"] / 2)).cast("string"), F.lit(", "), F.floor(b["y"] + F.floor(b["h"] / 2)).cast("string"), F.lit(")\n"))
    tags = F.array_join(F.transform(col(boxes), centre), "")
    return F.transform(col(codes), lambda c: F.when(F.trim(c).isin(*COMMANDS), c).otherwise(F.concat(tags, c)))


def candidates(text: Column | str) -> Column:
    """(reasoning, action) of a JSON list's objects that have both as strings that are not blank."""
    items = F.from_json(col(text), "array<struct<reasoning:string,action:string>>")
    trimmed = F.transform(items, lambda x: F.struct(stripped(x["reasoning"]).alias("reasoning"), stripped(x["action"]).alias("action")))
    return F.filter(trimmed, lambda x: (x["reasoning"] != "") & (x["action"] != ""))


def proposals(text: Column | str) -> Column:
    """Task descriptions of {tasks: [...]} or a list, of objects or of plain strings."""
    body = F.coalesce(F.get_json_object(col(text), "$.tasks"), col(text))
    items = F.from_json(body, "array<string>")
    said = F.transform(items, lambda x: F.coalesce(F.get_json_object(x, "$.description"), F.when(~F.startswith(F.ltrim(x), F.lit("{")), x)))
    return F.filter(said, lambda x: x.isNotNull() & (stripped(x) != ""))


def match_flag(text: Column | str) -> Column:
    """The `match` of a JSON verdict; false where there is none."""
    return F.coalesce(F.get_json_object(col(text), "$.match").try_cast("boolean"), F.lit(False))
