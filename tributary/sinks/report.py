from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Report:
    """What an export made: its text, a line for each action, and counts of what was sent, skipped and failed."""

    target: str
    artifact: str
    actions: list[str] = field(default_factory=list)
    sent: int = 0
    failed: int = 0
    skipped: int = 0
