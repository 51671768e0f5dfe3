"""Reading of stored chat turns: JSON lists of role and content, in any of their dirty forms."""

from __future__ import annotations

import json
import re

ASSISTANT = frozenset({"assistant", "gpt", "bot", "model"})
USER = frozenset({"user", "human"})

_PARTIAL = re.compile(r'"(content|value|role|from)"\s*:\s*"((?:[^"\\]|\\.)*)("?)')


def parse(stored: str | None) -> tuple[str, list[tuple[str, str | None]]]:
    """(state, turns) of a stored string; state is ``ok``, ``none`` (nothing there) or ``cut`` (the JSON stops short).

    Roles are lower case, ``human`` and ``gpt`` read as user and assistant.
    """
    if stored is None or not stored.strip() or stored.strip().lower() in ("null", "[]", "{}", '""'):
        return "none", []
    try:
        rows = json.loads(stored)
    except ValueError:
        return ("cut" if stored.lstrip()[:1] in "[{" else "none"), _partial(stored)
    if isinstance(rows, dict):
        rows = rows.get("messages") or rows.get("conversations") or [rows]
    turns = []
    for row in rows if isinstance(rows, list) else []:
        if isinstance(row, dict):
            role = str(row.get("role") or row.get("from") or "").strip().lower()
            text = row.get("content") if row.get("content") is not None else row.get("value")
            role = "assistant" if role in ASSISTANT else "user" if role in USER else role
            turns.append((role, text if isinstance(text, str) or text is None else json.dumps(text)))
    return ("ok" if turns else "none"), turns


def _partial(stored: str) -> list[tuple[str, str | None]]:
    """The turns that can still be read from a string that is cut off."""
    turns, role = [], ""
    for key, raw, _ in _PARTIAL.findall(stored):
        try:
            value = json.loads(f'"{raw}"')
        except ValueError:
            value = raw
        if key in ("role", "from"):
            role = value.lower()
        else:
            turns.append((role, value))
    return turns
