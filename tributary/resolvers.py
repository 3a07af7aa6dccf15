"""A seam for code that can say what an opaque step does; none is registered."""

from __future__ import annotations

from typing import Protocol


class Resolver(Protocol):
    def resolve(self, request: dict) -> list[dict]: ...


_known: list[Resolver] = []


def register(resolver: Resolver) -> None:
    _known.append(resolver)


def resolvers() -> list[Resolver]:
    return list(_known)
