"""Configuration files with ${NAME} references to the environment, and logging."""

from __future__ import annotations

import json
import logging
import os
import string
from collections.abc import Iterable
from pathlib import Path
from typing import Any


class _Reference(string.Template):
    """Only the braced form is a reference; any other dollar sign is text."""

    pattern = r"""\$(?:\{(?P<braced>[A-Za-z_][A-Za-z0-9_]*)\}|(?P<named>(?!))|(?P<escaped>(?!))|(?P<invalid>(?!)))"""


class _Environment(dict):
    def __missing__(self, name: str) -> str:
        return ""


def expand(tree: Any) -> Any:
    """A copy of nested dicts and lists in which ${NAME} stands replaced in every string; unset names are empty."""
    values = _Environment(os.environ)
    root = [tree]
    todo: list[tuple[Any, Any]] = [(root, 0)]
    while todo:  # a stack of places instead of recursion, so depth doesn't matter
        holder, at = todo.pop()
        item = holder[at]
        if isinstance(item, str):
            holder[at] = _Reference(item).substitute(values)
        elif isinstance(item, (dict, list)):
            holder[at] = item.copy()
            places: Iterable = item.keys() if isinstance(item, dict) else range(len(item))
            todo.extend((holder[at], place) for place in places)
    return root[0]


def _parse(text: str, kind: str) -> Any:
    if kind == ".json":
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)


def load_config(path: str | Path) -> dict:
    """Nested dict of a YAML or (by its suffix) JSON file; {} where it is empty; FileNotFoundError where there is none."""
    file = Path(path)
    text = file.read_text(encoding="utf-8")
    return expand(_parse(text, file.suffix.lower())) or {} if text.strip() else {}


def get_logger(name: str, level: int = logging.INFO) -> logging.Logger:
    """Logger of this name; where nobody has set up logging yet, records of `level` go to standard error."""
    logging.basicConfig(level=level, format="%(levelname)s\t%(name)s\t%(asctime)s\t%(message)s")  # does nothing once there is a handler
    return logging.getLogger(name)
