"""Semi-structured texts: YAML, Markdown and JSON to records. Plain Python values; operators.parsing applies them."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

_FENCE = re.compile(r"```json\s*(.*?)\s*```", re.DOTALL | re.IGNORECASE)
_NAMES = ("tool_name", "name", "id", "title")


def _json(text: str):
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def _objects(value) -> list[dict]:
    if isinstance(value, dict):
        return [value]
    return [x for x in value if isinstance(x, dict)] if isinstance(value, list) else []


def fenced(text: str | None) -> list[dict]:
    """The objects in ```json blocks; lists give their objects; a block that isn't JSON gives nothing."""
    return [x for body in _FENCE.findall(text or "") for x in _objects(_json(body))]


def bare(text: str | None) -> list[dict]:
    """The objects of a text that is one JSON object or list."""
    text = (text or "").strip()
    return _objects(_json(text)) if text[:1] + text[-1:] in ("{}", "[]") else []


def strings(value) -> Iterator[str]:
    """All text leaves, depth first."""
    if isinstance(value, str):
        yield value
    elif isinstance(value, dict | list):
        for x in value.values() if isinstance(value, dict) else value:
            yield from strings(x)


def under_tools(value) -> Iterator[dict]:
    """Objects under any key that reads tools, at any depth."""
    if isinstance(value, list):
        for x in value:
            yield from under_tools(x)
    elif isinstance(value, dict):
        for k, v in value.items():
            if str(k).strip().lower() == "tools":
                yield from _objects(list(v.values()) if isinstance(v, dict) and not any(n in v for n in _NAMES) else v)
            yield from under_tools(v)


def tool_name(tool: dict) -> str | None:
    return next((str(tool[n]).strip() for n in _NAMES if tool.get(n) is not None and str(tool[n]).strip()), None)


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, default=str)


def yaml_value(text: str | None):
    """The value of a YAML text, None if it can't be read."""
    import yaml

    try:
        return yaml.load(text or "", Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
    except (yaml.YAMLError, ValueError, RecursionError):
        return None


def extracted(text: str | None) -> list[dict]:
    """The named tools of a specification: of its fenced and bare JSON texts and of its tools keys, each once, in order."""
    value = yaml_value(text)
    if value is None or isinstance(value, str):
        value = text or ""
    found = [x for s in strings(value) for x in (*fenced(s), *bare(s))]
    found += [] if isinstance(value, str) else under_tools(value)
    seen: set[str] = set()
    return [x for x in found if tool_name(x) and (key := canonical_json(x)) not in seen and not seen.add(key)]


def slugged(name: str | None) -> str:
    kept = re.sub(r"[^A-Za-z0-9_-]", "", re.sub(r"\s+", "_", (name or "").strip()))[:80]
    return (kept or "tool").strip("_-")


def top_level(value) -> dict | None:
    """An object, or the first of a list if that is one."""
    value = value[0] if isinstance(value, list) and value else value
    return value if isinstance(value, dict) else None


def listed(text: str) -> list:
    """A list given in a fence, as YAML, or as JSON; ValueError if it is none of them."""
    m = re.search(r"```[a-z]*\s*(\[.*?\])\s*```", text, re.DOTALL)
    for candidate in (m and _json(m.group(1)), yaml_value(text), _json(text)):
        if isinstance(candidate, list):
            return candidate
    raise ValueError("no list in the text")


def coerced(text: str | None) -> dict:
    """A JSON object: the whole text, the first in a fence, or from the first { to the last }; else an error record."""
    text = text or ""
    m = re.search(r"```(?:json)?\s*(\{.*?\})\s*```", text, re.DOTALL)
    a, b = text.find("{"), text.rfind("}")
    for candidate in (text.strip(), m and m.group(1), text[a : b + 1] if 0 <= a < b else None):
        if candidate and isinstance(value := _json(candidate), dict):
            return value
    return {"_parse_error": True, "_raw": text}


VERDICTS = ("correct", "should_success_got_error", "should_error_got_success", "inappropriate_response", "unrealistic_behavior")


def verdict(text: str | None) -> tuple[str, float, str]:
    """(judgment, confidence, reasoning) of a judge's answer; unknown, 0.0 and why if it can't be read."""
    text = text or ""
    m = re.search(r"```(?:json)?\s*(\{.*?\})\s*```", text, re.DOTALL)
    a, b = text.find("{"), text.rfind("}")
    value = _json(m.group(1) if m else text[a : b + 1] if 0 <= a < b else text)
    if not isinstance(value, dict):
        return "unknown", 0.0, "the answer is not a JSON object"
    label = str(value.get("judgment", "")).strip().lower()
    try:
        confidence = float(value.get("confidence", 0.0))
    except (TypeError, ValueError):
        confidence = 0.0
    return label if label in VERDICTS else "unknown", confidence, str(value.get("reasoning") or "no reasoning given")


def balanced(text: str) -> str | None:
    """The first { to its closing }, outside JSON strings."""
    start, depth, quoted = text.find("{"), 0, False
    for m in re.finditer(r'\\.|["{}]', text[start:] if start >= 0 else "", re.DOTALL):
        if m.group() == '"':
            quoted = not quoted
        elif not quoted and m.group() in "{}":
            depth += 1 if m.group() == "{" else -1
            if not depth:
                return text[start : start + m.end()]
    return None


_TASK = re.compile(
    r'Task:\s*"(?P<task>(?:[^"\\]|\\.)*)"\s*,\s*Task-difficulty:\s*"(?P<difficulty>[^"]*)"\s*,\s*Number-tools-required:\s*(?P<number>\d+)\s*,'
    r'\s*Tools-required:\s*\[(?P<tools>[^\]]*)\]\s*,\s*Task-validity:\s*"(?P<validity>[^"]*)"',
    re.DOTALL,
)


def _names(text: str) -> list[str]:
    return [t for x in text.strip().strip("[]").split(",") if (t := x.strip().strip("\"'`"))]


def task_lines(text: str) -> list[dict]:
    """Tasks written as Task: "..", Task-difficulty: "..", Number-tools-required: n, Tools-required: [..], Task-validity: ".."."""
    return [
        {"task": m["task"], "task_difficulty": m["difficulty"], "number_tools_required": int(m["number"]), "tools_required": _names(m["tools"]), "task_validity": m["validity"]}
        for m in _TASK.finditer(text)
    ]


_HEAD = re.compile(r"^\W*\*\*\s*(Task\s*\d+)\s*:?\s*\*\*\s*:?\s*(.*)$", re.IGNORECASE)
_ATTRIBUTE = re.compile(r"^\W*\**\s*(Task[- ]difficulty|Number[- ]tools[- ]required|Tools[- ]required|Task[- ]validity)\s*\**\s*:\s*\**\s*(.*)$", re.IGNORECASE)


def markdown_tasks(text: str) -> list[dict]:
    """Tasks headed **Task n**, each with attribute lines up to a blank line or the next task."""
    out: list[dict] = []
    reading = False
    for line in text.splitlines():
        if m := _HEAD.match(line):
            out.append({"task_type": m[1], "task": m[2].strip().strip('"')})
            reading = True
        elif not line.strip():
            reading = False
        elif reading and (m := _ATTRIBUTE.match(line)):
            key, value = re.sub(r"[- ]", "_", m[1].lower()), m[2].strip().rstrip(",")
            if key == "tools_required":
                out[-1][key] = _names(value)
            elif key == "number_tools_required":
                out[-1][key] = int(n[0]) if (n := re.findall(r"\d+", value)) else None
            else:
                out[-1][key] = value.strip("\"'").lower()
    return out


def environment(text: str | None) -> dict:
    """An environment: YAML, of several documents the one with tasks or metadata, else its JSON and task lines; with Markdown tasks if it has no others."""
    import yaml

    text = text or ""
    value = yaml_value(text)
    if not isinstance(value, dict):
        try:
            documents = [d for d in yaml.safe_load_all(text) if isinstance(d, dict)]
        except (yaml.YAMLError, ValueError):
            documents = []
        value = next((d for d in documents if {"tasks", "metadata", "meta_data", "meta"} & {str(k).lower() for k in d}), None)
    if not isinstance(value, dict):
        value = _json(balanced(text) or "") or {}
        if tasks := task_lines(text):
            value = {**value, "tasks": tasks}
    if not got(value, "tasks") and (tasks := markdown_tasks(text)):
        value = {**value, "tasks": tasks}
    return value


def got(value: dict, *names: str):
    """The value of the first key that equals one of the names, in their order, ignoring case."""
    lowered = {}
    for k in value:
        lowered.setdefault(str(k).lower(), k)
    return next((value[lowered[n.lower()]] for n in names if n.lower() in lowered), None)


def tasks_of(value: dict) -> list[tuple[str, dict]]:
    """(task type, task) of an environment's tasks, however they are nested."""
    tasks, out = got(value, "tasks"), []
    if isinstance(tasks, dict):
        for group, items in tasks.items():
            out += [(f"{group}_{i}", x) for i, x in enumerate(items, 1)] if isinstance(items, list) else [(str(group), items)]
    elif isinstance(tasks, list):
        out = [(str((got(x, "task_type", "id") if isinstance(x, dict) else None) or f"task_{i}"), x) for i, x in enumerate(tasks, 1)]
    return [(name, x if isinstance(x, dict) else {"task": x}) for name, x in out]


def metadata_of(value: dict) -> dict:
    """Metadata, then data, of an environment; all but the tasks if it has neither."""
    out: dict = {}
    for names in (("meta_data", "metadata", "meta"), ("data", "data_section", "content")):
        part = got(value, *names)
        if isinstance(part, dict):
            out |= part
        elif part is not None:
            out[names[0]] = part
    return out or {k: v for k, v in value.items() if str(k).lower() != "tasks"}


#: Keys of task metadata that an agent doesn't get.
HIDDEN = ("field_name", "subfield", "task", "tool_budget", "tool_sequences")


def shown_metadata(value: dict) -> dict:
    """Without HIDDEN, under meta_data if there is such a key, else at the top."""
    if isinstance(value.get("meta_data"), dict):
        return {**value, "meta_data": {k: v for k, v in value["meta_data"].items() if k not in HIDDEN}}
    return {k: v for k, v in value.items() if k not in HIDDEN}


def context_metadata(value: dict) -> dict:
    return {k: v for k, v in value.items() if k not in ("Tool Call", "Return Data")}


def search_text(tool: dict) -> str:
    """The text that stands for a tool in exact deduplication, before basic normalisation."""
    parts = [str(tool.get("tool_name") or tool.get("name") or ""), str(tool.get("tool_description") or tool.get("description") or "")]
    for key, with_default in (("parameters", True), ("output_details", False)):
        if key == "output_details":
            parts += map(str, tool["error_messages"] if isinstance(tool.get("error_messages"), list) else [])
            parts += [str(tool["usage"])] if tool.get("usage") else []
        if isinstance(tool.get(key), dict):
            for name in sorted(tool[key]):
                parts.append(str(name))
                if isinstance(spec := tool[key][name], dict):
                    parts += [str(spec.get("description", "")), str(spec.get("type", ""))]
                    parts += [str(spec["default"])] if with_default and "default" in spec else []
    return "\n".join(parts)


def embedding_text(tool: dict) -> str:
    """The four lines that stand for a tool in its embedding."""
    flat = lambda x: " ".join(str("" if x is None else x).split())
    given = tool.get("parameters") or {}
    items = list(given.items()) if isinstance(given, dict) else [(p.get("name", ""), p) for p in given]
    entries = []
    for name, spec in sorted(items, key=lambda kv: str(kv[0]).lower()):
        needed, default = spec.get("required"), spec.get("default")
        entries.append("|".join([flat(name), flat(spec.get("type", "")), "none" if needed is None else str(needed), "none" if default is None else flat(default), flat(spec.get("description")).lower()]))
    rows = {"name": flat(tool.get("tool_name")).lower(), "description": flat(tool.get("tool_description")).lower(), "parameters": f"[{' ; '.join(entries)}]", "usage": flat(tool.get("usage")).lower()}
    return "\n".join(f"{k}: {v}" for k, v in rows.items())
