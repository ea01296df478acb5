"""Program arguments: names with types, defaults and required flags."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Argument:
    name: str
    kind: type = str
    default: Any = None
    required: bool = False
    about: str = ""


def truth(value: str) -> bool:
    """Whether the text begins with T or Y, in any case."""
    return value.strip()[:1].upper() in ("T", "Y")


def parse(arguments: list[Argument], words: list[str]) -> dict[str, Any]:
    """Values of ``-name value`` words; unknown names, missing values and missing required arguments are errors."""
    known, out = {a.name.lower(): a for a in arguments}, {a.name: a.default for a in arguments}
    if len(words) % 2:
        raise ValueError("arguments come in pairs of a name and a value")
    for name, value in zip(words[::2], words[1::2], strict=True):
        found = known.get(name.lstrip("-").lower())
        if found is None:
            raise ValueError(f"unknown argument {name}")
        out[found.name] = truth(value) if found.kind is bool else found.kind(value)
    missing = [a.name for a in arguments if a.required and out[a.name] is None]
    if missing:
        raise ValueError(f"missing arguments: {', '.join(missing)}")
    return out

