"""The queries of this subpackage, each with its check SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from foldsafe.plans.registry import Build, Query

REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    def keep(build: Build) -> Build:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, build, sql)
        return build

    return keep
