"""Flags of a command line: `--name value value`, read by the type that is asked for."""

from __future__ import annotations

from typing import Any

_MISSING = object()


class UnrecognizedFlag(KeyError):
    """A flag without default that wasn't given."""


class Flags:
    """Values run to the next word with a dash; words before the first flag are left out, and a flag given again replaces the first."""

    def __init__(self, words: list[str]):
        self.values: dict[str, list[str]] = {}
        own: list[str] | None = None
        for word in words:
            if word.startswith("--"):
                own = self.values[word[2:]] = []
            elif word.startswith("-"):
                own = None
            elif own is not None:
                own.append(word)

    def get(self, name: str, kind: Any = str, default: Any = _MISSING) -> Any:
        """The flag as str, int, float or bool (given or not), or as a list of them by [kind]."""
        if name not in self.values:
            if default is _MISSING:
                raise UnrecognizedFlag(name)
            return default
        found = self.values[name]
        if isinstance(kind, list):
            return [kind[0](x) for x in found]
        if kind is bool:
            return True
        if kind is str:
            return found[0] if found else ""
        return kind(found[0])
