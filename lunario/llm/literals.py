"""What every match of a pattern contains: a cheap test before a costly pattern, derived from the pattern itself.

A gate lets through every text that its patterns match. It may let others through, so the patterns are still asked.
"""

from __future__ import annotations

import re
from itertools import product

#: Literals of a set at most; beyond that a sequence is cut and its best part taken.
MANY = 64


def alternatives(pattern: str) -> list[str]:
    """The outermost alternatives of a pattern, each with the pattern's leading flags."""
    flags = re.match(r"(?:\(\?[a-z]+\))?", pattern)[0]
    parts, depth, inside, start, i = [], 0, False, len(flags), len(flags)
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            parts.append(pattern[start:i])
            start = i + 1
        i += 1
    return [flags + p for p in [*parts, pattern[start:]]]


def _worth(literals: set[str] | None) -> tuple:
    """Sets of long literals are worth most, then small sets; 0 if nothing is asked. Marks that prose lacks are worth three letters."""
    if not literals or "" in literals:
        return (0, 0)
    return (min(len(x.strip()) if re.search(r"[^\W_]", x) else 3 * bool(re.search(r"[^\s.,:;!?'()-]", x)) for x in literals), -len(literals))


def _of(node) -> tuple[set[str] | None, set[str] | None]:
    """All texts of a parsed sequence if they are few, and the best set of which every match contains one."""
    exact: set[str] | None = {""}
    whole, found = True, []
    for op, arg in node:
        own, need = None, None
        match str(op):
            case "LITERAL":
                own = {chr(arg).lower()}
            case "IN" if all(str(o) == "LITERAL" for o, _ in arg) and len(arg) <= 8:
                own = {chr(v).lower() for _, v in arg}
            case "AT" | "ASSERT_NOT":
                own = {""}
            case "ASSERT":
                own, need = {""}, _of(arg[1])[1]
            case "SUBPATTERN":
                own, need = _of(arg[3])
            case "BRANCH":
                ways = [_of(way) for way in arg[1]]
                own = set().union(*[e for e, _ in ways]) if all(e is not None for e, _ in ways) else None
                need = set().union(*[n for _, n in ways]) if all(n is not None for _, n in ways) else None
            case "MAX_REPEAT" | "MIN_REPEAT":
                low, high, sub = arg
                e, n = _of(sub)
                own = (e if low else e | {""}) if high == 1 and e is not None else None
                need = n if low else None
        if own is not None and len(own) > MANY:
            own, need = None, max(own, need, key=_worth) if need else own
        if need is not None:
            found.append(need)
        if own is not None and len(exact) * len(own) <= MANY:
            exact = {a + b for a, b in product(exact, own)}
            continue
        found.append(exact)
        whole, exact = False, own if own is not None else {""}
    best = max([*found, exact], key=_worth)
    return exact if whole else None, best if _worth(best)[0] else None


def needed(pattern: str) -> set[str] | None:
    """Texts in lower case, one of which every match of the pattern contains in lower case; none if there are no such texts."""
    return _of(re._parser.parse(re.sub(r"\\[1-9]", r"\\w*", pattern)))[1]


def by_literal(patterns, least: int = 2) -> list[tuple[str, set[str]]]:
    """Every alternative of the patterns with the literals one of which its matches contain; none if none is worth it."""
    out = []
    for p in patterns:
        # Numbered groups count over the whole pattern, so a pattern with references stays whole.
        for way in [p] if re.search(r"\\[1-9]", p) else alternatives(p):
            need = needed(way)
            out.append((way, need if _worth(need)[0] >= least else set()))
    return out
