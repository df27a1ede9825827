"""Steps of a run from a file of settings: python -m tallyforge.plans.steps SETTINGS [--step NAME] [--dry-run]."""

from __future__ import annotations

import argparse
import subprocess
import sys
from collections.abc import Callable, Mapping

from ..sources.readers import settings


def arguments(section: Mapping, renamed: Mapping[str, str] | None = None) -> list[str]:
    """Settings as command-line arguments: null and false are left out, true is a flag, lists give several values."""
    out = []
    for key, value in section.items():
        if value is None or value is False:
            continue
        out.append("--" + (renamed or {}).get(key, key).replace("_", "-"))
        if value is not True:
            out += [str(v) for v in value] if isinstance(value, list | tuple) else [str(value)]
    return out


def run(sections: Mapping[str, Mapping], commands: Mapping[str, list[str]], only: str | None = None, dry: bool = False, start: Callable[[list[str]], int] | None = None) -> dict[str, int]:
    """Exit codes of the steps, in the commands' order, up to the first that fails. A step without settings is skipped and has no code."""
    start = start or (lambda command: subprocess.run(command, check=False).returncode)
    codes: dict[str, int] = {}
    for name, command in commands.items():
        if (only and name != only) or name not in sections:
            continue
        whole = [*command, *arguments(sections[name])]
        print(" ".join(whole), flush=True)
        codes[name] = 0 if dry else start(whole)
        if codes[name]:
            break
    return codes


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("settings")
    parser.add_argument("--step")
    parser.add_argument("--dry-run", action="store_true")
    given = parser.parse_args(argv)
    sections = settings(given.settings)
    commands = {name: list(section["command"]) for name, section in sections.items() if isinstance(section, dict) and "command" in section}
    plain = {name: {k: v for k, v in sections[name].items() if k != "command"} for name in commands}
    return max(run(plain, commands, given.step, given.dry_run).values(), default=0)


if __name__ == "__main__":
    sys.exit(main())
