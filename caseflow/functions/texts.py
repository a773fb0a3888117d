"""SQL text literals and sentences with filled-in values."""

from __future__ import annotations

from string import Formatter


def quoted(text: str) -> str:
    """The text as an SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def filled(template: str, **values: str) -> str:
    """SQL for a ``{name}`` template whose values are SQL expressions."""
    parts = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append(quoted(literal))
        if name:
            parts.append(f"string({values[name]})")
    return f"concat({', '.join(parts)})"
