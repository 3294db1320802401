"""Boolean trigram queries of regular expressions, worked out on the driver from the parsed pattern.

A query is a list of alternatives, each a set of trigrams that a match must contain in lower case: the
text must hold all trigrams of some alternative. An empty list means that nothing is mandatory.
"""

from __future__ import annotations

from re import _constants as op
from re import _parser

#: Strings that one stretch of a pattern may expand to; a longer list is given up, which only weakens the query.
_EXPAND = 64


def _strings(item) -> list[str] | None:
    """The few strings that a parsed node stands for, or None."""
    kind, arg = item
    if kind is op.LITERAL:
        return [chr(arg).lower()]
    if kind is op.IN and all(k is op.LITERAL for k, _ in arg) and len(arg) <= 4:
        return sorted({chr(a).lower() for _, a in arg})
    if kind is op.SUBPATTERN:
        return _product(arg[3])
    if kind is op.BRANCH:
        parts = [_product(x) for x in arg[1]]
        return None if any(p is None for p in parts) else [s for p in parts for s in p]
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[1] != op.MAXREPEAT and arg[1] <= 2:
        part = _product(arg[2])
        if part is None:
            return None
        out, power = [], [""]
        for n in range(arg[1] + 1):
            out += power if n >= arg[0] else []
            power = [a + b for a in power for b in part]
        return out
    return None


def _product(items) -> list[str] | None:
    out = [""]
    for item in items:
        part = _strings(item)
        if part is None or len(out) * len(part) > _EXPAND:
            return None
        out = [a + b for a in out for b in part]
    return out


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """The strongest stretch of the pattern that expands to few strings of three or more characters each."""
    best: list[frozenset[str]] = []
    run = [""]

    def close():
        nonlocal best
        alternatives = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run]
        if all(alternatives) and (not best or min(map(len, alternatives)) > min(map(len, best))):
            best = list(dict.fromkeys(alternatives))

    for item in _parser.parse(pattern):
        part = _strings(item)
        if part is None or len(run) * len(part) > _EXPAND:
            close()
            run = [""] if part is None else part
        else:
            run = [a + b for a in run for b in part]
    close()
    return best
