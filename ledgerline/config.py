"""Settings as nested dictionaries: defaults, overrides 'a.b=value', references '${a.b}' and '${env:NAME}'."""

from __future__ import annotations

import copy
import json
import os
import re
from collections.abc import Iterable

REFERENCE = re.compile(r"\$\{([^{}]+)\}")


def value_of(text: str):
    """A JSON value, or the text itself."""
    try:
        return json.loads(text)
    except ValueError:
        return text


def look_up(settings: dict, path: str):
    found = settings
    for part in path.split("."):
        if not isinstance(found, dict) or part not in found:
            raise KeyError(f"no setting {path}")
        found = found[part]
    return found


def overridden(defaults: dict, overrides: Iterable[str]) -> dict:
    """defaults with 'a.b=value' put in; only settings that exist can be changed, '+a.b=value' adds one."""
    out = copy.deepcopy(defaults)
    for text in overrides:
        path, sign, value = text.partition("=")
        if not sign:
            raise ValueError(f"not a setting: {text!r}")
        new, path = path.startswith("+"), path.removeprefix("+")
        *parents, last = path.split(".")
        if not new:
            look_up(out, path)
        at = out
        for part in parents:
            at = at.setdefault(part, {})
        at[last] = value_of(value)
    return out


def resolved(settings: dict) -> dict:
    """Settings with references replaced; one that stands alone keeps its type, a circle is an error."""

    def walk(value, path: tuple[str, ...]):
        if isinstance(value, dict):
            return {k: walk(v, path) for k, v in value.items()}
        if isinstance(value, list):
            return [walk(v, path) for v in value]
        if not isinstance(value, str):
            return value

        def one(name: str):
            if name in path:
                raise ValueError("settings refer to each other: " + " -> ".join([*path, name]))
            if name.startswith("env:"):
                if (found := os.environ.get(name[4:])) is None:
                    raise KeyError(f"no environment variable {name[4:]}")
                return found
            return walk(look_up(settings, name), (*path, name))

        whole = REFERENCE.fullmatch(value)
        return one(whole[1]) if whole else REFERENCE.sub(lambda m: str(one(m[1])), value)

    return walk(settings, ())


def load(defaults: dict, overrides: Iterable[str] = ()) -> dict:
    return resolved(overridden(defaults, overrides))
