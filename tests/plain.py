"""Plain versions for comparison."""

import re

from larder.functions.values import FORM_CHANGING, QUALIFIERS

_BREAK = re.compile(r"[\s·,]+")


def relevance(kw: str, name: str) -> int:
    """text.relevance for one pair, in plain Python."""
    kw, name = kw.lower(), name.lower()
    ws = [w for w in _BREAK.split(name) if w]
    if any(w.startswith(kw) and w[len(kw) :] in FORM_CHANGING for w in ws):
        return 0
    edge = lambda w: w.startswith(kw) or w.endswith(kw)
    first, second = (ws + ["", ""])[:2]
    if edge(first) or (edge(second) and first in QUALIFIERS):
        return 4
    if re.search(rf"(?:^|\s){re.escape(kw)}(?:\s|\d|$)", name):
        return 3
    if re.search(rf"{re.escape(kw)}(?:[\s\d,.)·;!?]|$)", name) or any(w.startswith(kw) and len(w) > len(kw) for w in ws):
        return 2
    return int(kw in name)
