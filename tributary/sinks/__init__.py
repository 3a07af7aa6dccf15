"""Exports of a document, by name."""

from __future__ import annotations

from . import dot, openlineage, openmetadata

TARGETS = {"dot": dot.export, "graphviz": dot.export, "openlineage": openlineage.export, "ol": openlineage.export, "openmetadata": openmetadata.export, "om": openmetadata.export}


def export(document, target: str, **options):
    """The report of an export; ``KeyError`` names targets that don't exist."""
    if target not in TARGETS:
        raise KeyError(f"unknown target {target!r}: one of {', '.join(sorted(TARGETS))}")
    return TARGETS[target](document, **options)
