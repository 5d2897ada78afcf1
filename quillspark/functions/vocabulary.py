"""Word lists of the rules, read once from the package's data file."""

from __future__ import annotations

import json
import re
from functools import lru_cache
from importlib import resources


@lru_cache(1)
def vocabulary() -> dict:
    return json.loads(resources.files("quillspark").joinpath("data/vocabulary.json").read_text(encoding="utf-8"))


def words(name: str) -> list[str]:
    return list(vocabulary()[name])


def mapping(name: str) -> dict[str, str]:
    return dict(vocabulary()[name])


def either(terms: list[str]) -> str:
    """Alternation of literal terms, longest first, so that no term hides a longer one."""
    return "(?:" + "|".join(re.sub(r"([.\-+*?^$()\[\]{}|\\])", r"\\\1", t) for t in sorted(terms, key=lambda t: (-len(t), t))) + ")"
