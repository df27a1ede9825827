"""Names, identifiers and texts, as column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ID = r"(?i)^([a-z0-9_]+)_tool_spec_(\d+)(?:__|$)"


def stripped(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _found(value: Column) -> Column:
    return F.when(value != "", value)


def id_name(tool_id: Column) -> Column:
    """What follows the first double underscore; the whole id where there is none."""
    at = F.locate("__", tool_id)
    return F.when(at > 0, F.substring(tool_id, at + 2, F.length(tool_id))).otherwise(tool_id)


def id_field(tool_id: Column) -> Column:
    """The field in an id, else unknown."""
    return F.coalesce(_found(F.regexp_extract(tool_id, _ID, 1)), F.lit("unknown"))


def id_spec(tool_id: Column) -> Column:
    """The specification's number in an id, else null."""
    return _found(F.regexp_extract(tool_id, _ID, 2)).cast("long")


def id_number_text(tool_id: Column) -> Column:
    """The specification's number as text, of ids that go on with a name; else unknown."""
    return F.coalesce(_found(F.regexp_extract(tool_id, r"(?i)^([a-z0-9_]+)_tool_spec_(\d+)__", 2)), F.lit("unknown"))


def basic(text: Column) -> Column:
    """Lower case, with every run of anything but a-z and 0-9 as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def first_given(*values: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.when(v != "", v) for v in values))


def normalized_name(tool_name: Column, name: Column, tool_id: Column) -> Column:
    return basic(first_given(tool_name, name, id_name(tool_id)))


def fingerprint(text: Column) -> Column:
    """The first 12 hexadecimal digits of SHA-1."""
    return F.substring(F.sha1(text), 1, 12)


def safe_file_name(text: Column) -> Column:
    """Each character outside A-Z a-z 0-9 . _ - as an underscore."""
    return F.regexp_replace(text, "[^A-Za-z0-9._-]", "_")


def plain_file_name(text: Column) -> Column:
    """Blanks and slashes as underscores."""
    return F.translate(text, " /\\", "___")


def slug(text: Column) -> Column:
    """Words joined by underscores, at most 80 characters, without _ or - at the ends; tool if nothing is left."""
    kept = F.regexp_replace(F.regexp_replace(F.trim(text), r"(?U)\s+", "_"), "[^A-Za-z0-9_-]", "")
    cut = F.substring(kept, 1, 80)
    return F.regexp_replace(F.when(cut == "", F.lit("tool")).otherwise(cut), "^[_-]+|[_-]+$", "")


def lookup_name(name: Column) -> Column:
    """Letters and digits only, in lower case: how tools are looked up."""
    return F.lower(F.regexp_replace(name, "[^A-Za-z0-9]", ""))


def joined_name(name: Column) -> Column:
    """Runs of anything but letters and digits as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")


def tau_key(tau: Column) -> Column:
    """A threshold with up to six decimals and no trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", tau.cast("double")), "0+$", ""), "\\.$", "")


def seeded_hash(seed: int, tool_id: Column) -> Column:
    """64 hexadecimal digits; their order is the order of the hash as a number."""
    return F.sha2(F.concat(F.lit(f"{seed}|"), tool_id.cast("string")), 256)


def indented(text: Column, prefix: str) -> Column:
    """Every line with the prefix before it; of an empty text the prefix."""
    return F.concat(F.lit(prefix), F.replace(text, F.lit("\n"), F.lit("\n" + prefix)))


def title(field: Column) -> Column:
    return F.initcap(F.replace(field, F.lit("_"), F.lit(" ")))


def without_speaker(text: Column) -> Column:
    """Without user: or agent: at the start."""
    return F.trim(F.regexp_replace(text, r"^\s*(user|agent):", ""))


def one_line(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(" "))


def after_thinking(text: Column) -> Column:
    """What follows the last </think>, or all."""
    return F.element_at(F.split(text, "</think>"), -1)


def environment_path(path: Column) -> Column:
    """stem.environment.suffix."""
    return F.regexp_replace(path, r"(\.[^./]+)$", ".environment$1")


def without_fence(text: Column) -> Column:
    """The body of the first fenced block; without its first line if the fence isn't closed; else as it is."""
    body = F.regexp_extract(text, r"(?s)```[^\n]*\n(.*?)```", 1)
    opened = F.ltrim(text).startswith("```")
    return F.when(text.rlike(r"(?s)```[^\n]*\n.*?```"), stripped(body)).when(opened, F.regexp_replace(F.ltrim(text), r"^[^\n]*\n?", "")).otherwise(text)


def agent_response(text: Column) -> Column:
    """Of a simulator's answer: its status line and what stands from Response: up to Explanation:."""
    lines = F.split(text, "\n")
    bare = F.transform(lines, stripped)
    first = lambda mark: F.array_position(F.transform(bare, lambda x: x.startswith(mark)), True)
    explained = first("Explanation:")
    # only a Response: before the first Explanation: counts
    heads = F.when(explained > 0, F.slice(bare, 1, (explained - 1).cast("int"))).otherwise(bare)
    responses = F.filter(F.transform(heads, lambda x, i: F.when(x.startswith("Response:"), i + 1)), lambda x: x.isNotNull())
    start = F.try_element_at(responses, F.lit(-1))
    status = F.try_element_at(F.filter(bare, lambda x: x.startswith("Status Code:")), F.lit(1))
    until = F.when(explained > 0, explained - 1).otherwise(F.size(lines))
    body = F.slice(lines, start.cast("int"), F.greatest(until - start + 1, F.lit(0)).cast("int"))
    return F.when(start.isNull(), text).otherwise(stripped(F.array_join(F.concat(F.when(status.isNull(), F.array().cast("array<string>")).otherwise(F.array(status)), body), "\n")))


def filled(template: Column, **values: Column) -> Column:
    """The template with each {name} given, and doubled braces as single ones."""
    out = F.replace(F.replace(template, F.lit("{{"), F.lit("\x01")), F.lit("}}"), F.lit("\x02"))
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return F.replace(F.replace(out, F.lit("\x01"), F.lit("{")), F.lit("\x02"), F.lit("}"))


def filled_block(template: Column, placeholder: str, block: Column) -> Column:
    """The line that is only the placeholder replaced by the block, indented like it; an error where there is none."""
    pattern = rf"(?m)^([ \t]*)\{{{placeholder}\}}[ \t]*$"
    indent = F.regexp_extract(template, pattern, 1)
    whole = F.regexp_extract(template, pattern, 0)
    put = F.concat(indent, F.replace(block, F.lit("\n"), F.concat(F.lit("\n"), indent)))
    return F.when(template.rlike(pattern), F.replace(template, whole, put)).otherwise(F.raise_error(F.lit(f"the template has no line {{{placeholder}}}")))
