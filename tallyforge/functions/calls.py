"""Function calls in text: finding, normalising, rendering, decoding. Plain Python values; operators.calls applies them."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

_NAME = re.compile(r"[^\W\d]\w*")
#: What a scan inside brackets stops at: an escape, a quotation mark, a bracket.
_STOP = re.compile(r"\\.|[\"'()]", re.DOTALL)


def _closing(text: str, at: int) -> int:
    """The place after the bracket that closes the one before at, outside quotes and escapes; -1 if none does."""
    depth, quote = 1, ""
    for m in _STOP.finditer(text, at):
        found = m.group()
        if found[0] == "\\":
            continue
        if quote:
            quote = "" if found == quote else quote
        elif found in "\"'":
            quote = found
        else:
            depth += 1 if found == "(" else -1
            if not depth:
                return m.end()
    return -1


def scanned(text: str | None) -> Iterator[tuple[int, int, int]]:
    """(start of name, opening bracket, end) of each call; end is -1 for one that isn't closed, which is the last."""
    text, at = text or "", 0
    while m := _NAME.search(text, at):
        at = m.end()
        opening = at + len(text[at:]) - len(text[at:].lstrip()) if text[at : at + 1].isspace() else at
        if text[opening : opening + 1] == "(":
            end = _closing(text, opening + 1)
            yield m.start(), opening, end
            if end < 0:
                return
            at = end


def all_calls(text: str | None) -> list[str]:
    """Every call in order, up to the first that isn't closed."""
    return [text[a:c] for a, _, c in scanned(text) if c >= 0]


def first_calls(text: str | None, n: int = 1, tool_name: str | None = None) -> list[str]:
    """The first n calls; with a tool_name their name is replaced by it."""
    out = []
    for a, b, c in scanned(text):
        if c < 0 or len(out) >= n:
            break
        out.append(tool_name + text[b:c] if tool_name else text[a:c])
    return out


_CALL = re.compile(r"\s*([^(\s]+|[^()]+?)\s*\((.*)\)\s*$", re.DOTALL)
_PART = re.compile(r'"(?:\\.|[^"\\])*"?|[\[\]{}(),]|[^"\[\]{}(),]+', re.DOTALL)


def _arguments(body: str) -> list[str]:
    """The body cut at commas outside brackets and double quotes; single quotes don't protect a comma."""
    depth = {"[": 0, "{": 0, "(": 0}
    parts, now = [], []
    for token in _PART.findall(body):
        if token in depth:
            depth[token] += 1
        elif token in ("]", "}", ")"):
            opened = {"]": "[", "}": "{", ")": "("}[token]
            depth[opened] = max(0, depth[opened] - 1)
        if token == "," and not any(depth.values()):
            parts.append("".join(now).strip())
            now = []
        else:
            now.append(token)
    return [*parts, "".join(now).strip()] if now else parts


def normalised(call: str) -> tuple[str, dict[str, str]]:
    """(name, parameters): values stay text; what has no = is left out; a later one of the same name wins."""
    call = call.strip()
    if m := _CALL.match(call):
        name, body = m.group(1), m.group(2)
    else:
        at = call.rfind("(")
        if at < 0 or not call.endswith(")"):
            return call, {}
        name, body = call[:at], call[at + 1 : -1]
    pairs = (p.split("=", 1) for p in _arguments(body) if "=" in p)
    return name.strip(), {k.strip(): v.strip() for k, v in pairs}


def canonical(call: str) -> str:
    """A call as a string that doesn't depend on the order of parameters, on white space or on case."""
    return canonical_of(*normalised(call))


def canonical_of(name: str, parameters: dict[str, str]) -> str:
    """canonical() of a call that is normalised already."""
    text = json.dumps({"tool_name": name, "parameters": parameters}, sort_keys=True, separators=(",", ":"))
    return "".join(text.split()).lower()


def verified(attempt: list[str], solution: list[str], in_order: bool) -> bool:
    """Whether the calls are the solution's: as a sequence, or as a multiset."""
    a, b = [canonical(c) for c in attempt], [canonical(c) for c in solution]
    return a == b if in_order else sorted(a) == sorted(b)


_BLOCKS = (re.compile(r"<ATTEMPT>(.*?)<ATTEMPT>", re.DOTALL), re.compile(r"<ATTEMPT_START>(.*?)<ATTEMPT_END>", re.DOTALL))


def attempts(text: str | None) -> list[str]:
    """The bodies between two <ATTEMPT> tags, then those between <ATTEMPT_START> and <ATTEMPT_END>."""
    return [body.strip() for block in _BLOCKS for body in block.findall(text or "")]


def without_attempts(text: str | None) -> str:
    text = text or ""
    for block in _BLOCKS:
        text = block.sub("", text)
    return text.strip()


def extraneous(attempt: str) -> bool:
    """Whether an attempt holds more than its calls and white space."""
    return "".join(attempt.split()) != "".join("".join(c.split()) for c in all_calls(attempt))


def solution_calls(items) -> list[str]:
    """The calls of a solution: texts, and the text values of mappings with one key; all else is left out."""
    out = []
    for item in items or []:
        if isinstance(item, dict) and len(item) == 1:
            (item,) = item.values()
        if isinstance(item, str):
            out.append(item)
    return out


def rendered(tool_id: str, arguments: dict) -> str:
    """Name[p = v, q = 'text'] of a tool's example call; the name is what follows _tool_spec_<n>__ in the id."""
    m = re.search(r"_tool_spec_\d+__(.+)$", tool_id)
    if not m:
        raise ValueError(f"no tool name in the id {tool_id}")
    return f"{m.group(1)}[{', '.join(f'{k} = {v!r}' for k, v in arguments.items())}]"


_RENAMED = {"class": "cabin", "pass": "password"}


def rendered_keywords(name: str, arguments: dict) -> str:
    """[name(k = v, ...)]: without empty values, with reserved words renamed, mappings as lists of one."""

    def shown(value):
        if isinstance(value, str):
            return '"' + value.replace('"', "'") + '"'
        return repr([value] if isinstance(value, dict) else value)

    given = ((k, v) for k, v in arguments.items() if v is not None and v != "")
    return f"[{name}({', '.join(f'{_RENAMED.get(k, k)} = {shown(v)}' for k, v in given)})]"


def _literal(node: ast.expr):
    """The value of a literal, without running anything: sums, calls and names become their source text."""
    match node:
        case ast.Constant(value=v):
            return v
        case ast.UnaryOp(op=ast.USub(), operand=ast.Constant(value=int() | float() as v)):
            return -v
        case ast.List(elts=e):
            return [_literal(x) for x in e]
        case ast.Tuple(elts=e):
            return tuple(_literal(x) for x in e)
        case ast.Dict(keys=k, values=v):
            return {_literal(x): _literal(y) for x, y in zip(k, v) if x is not None}
        case ast.Call():
            return dict([_decoded_call(node)])
        case _:
            return ast.unparse(node)


def _decoded_call(node: ast.Call) -> tuple[str, dict]:
    return ast.unparse(node.func), {k.arg: _literal(k.value) for k in node.keywords if k.arg}


def decoded(text: str) -> list[dict[str, dict]]:
    """Calls in Python's syntax, in brackets or not, as [{name: {parameter: value}}]; ValueError if they can't be read."""
    text = text.strip()
    text = text if text.startswith("[") and text.endswith("]") else f"[{text.strip(chr(39) + '[]')}]"
    try:
        tree = ast.parse(text, mode="eval").body
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        raise ValueError(f"not a list of calls: {e}") from None
    nodes = [x for y in tree.elts for x in (y.elts if isinstance(y, ast.Tuple | ast.List) else [y])]
    if not all(isinstance(n, ast.Call) for n in nodes):
        raise ValueError("not a list of calls")
    return [dict([_decoded_call(n)]) for n in nodes]


def decoded_any(text: str, model: str) -> list[dict[str, dict]]:
    """decoded(); for models that call functions (FC in the name) a JSON list of {name: JSON text of arguments}."""
    if "FC" not in model:
        return decoded(text)
    return [{name: json.loads(a) if isinstance(a, str) else a} for item in json.loads(text) for name, a in item.items()]


def rebuilt(calls: list[dict[str, dict]]) -> list[str]:
    """name(parameter=value, ...) of decoded calls; a mapping whose value is a mapping is shown as a call."""

    def shown(value):
        if isinstance(value, dict) and value and isinstance(next(iter(value.values())), dict):
            return rebuilt([value])[0]
        return repr(value)

    return [f"{name}({', '.join(f'{k}={shown(v)}' for k, v in arguments.items())})" for c in calls for name, arguments in list(c.items())[:1]]


def is_agent_turn(text: str | None, steps: bool = False) -> bool:
    """Whether a message holds calls in square brackets that can be read (steps: starts with brackets)."""
    text = (text or "").strip()
    if steps:
        return bool(re.match(r"\[.*?\]", text, re.DOTALL))
    m = re.search(r"\[.*\]", text, re.DOTALL)
    try:
        return bool(m) and bool(decoded(m.group()))
    except ValueError:
        return False
