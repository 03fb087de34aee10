"""Name lookup for operators and sources."""

from __future__ import annotations

import logging
from collections.abc import Callable

log = logging.getLogger(__name__)


class Registry:
    """Maps a name used in pipeline specs to a Python callable."""

    def __init__(self, kind: str):
        self.kind = kind
        self._entries: dict[str, Callable] = {}

    def register(self, *names: str) -> Callable[[Callable], Callable]:
        def add(fn: Callable) -> Callable:
            for name in names:
                if name in self._entries:
                    log.warning("%s '%s' is registered again", self.kind, name)
                self._entries[name] = fn
            return fn

        return add

    def get(self, name: str) -> Callable:
        if name not in self._entries:
            known = ", ".join(sorted(self._entries))
            raise KeyError(f"{self.kind} '{name}' is not registered (known: {known})")
        return self._entries[name]

    def names(self) -> list[str]:
        return sorted(self._entries)

    def __contains__(self, name: str) -> bool:
        return name in self._entries


# Operators have the type (DataFrame, params, RunContext) -> DataFrame.
OPERATORS = Registry("operator")
# Sources have the type (StepSpec, request, RunContext) -> DataFrame.
SOURCES = Registry("source")
