"""Names of aggregate columns, from what they compute. Pure text, no session."""

from __future__ import annotations

#: Words that a pattern may hold, in the order in which they are filled in.
TOKENS = ("FUNCTION", "NUMERICAL", "FILTERS")


def pivot_piece(column: str, value: object, name: str | None) -> str:
    """``column=value``; with a name, the name with the value in place of PIVOTVALUE, or after it."""
    if name is None:
        return f"{column}={value}"
    if name.count("PIVOTVALUE") > 1:
        raise ValueError("A pivot name holds PIVOTVALUE at most once")
    return name.replace("PIVOTVALUE", str(value)) if "PIVOTVALUE" in name else f"{name}{value}"


def aggregate_name(function: str, numerical: str, filters: str = "", pivot: tuple[str, object, str | None] | None = None, pattern: str | None = None) -> str:
    """The output name of one aggregate column.

    Without a pattern: ``fn(col)``, then ``_where_`` with the filters, the pivot, or both joined by ``_``. A pattern's
    words are replaced in order; a pivoted column whose pattern has no pivot word gets the pivot at its end.
    """
    piece = pivot_piece(*pivot) if pivot else ""
    if pattern is None:
        tail = "_".join(x for x in (filters, piece) if x)
        return f"{function}({numerical})" + (f"_where_{tail}" if tail else "")
    name = pattern
    for token, text in zip(TOKENS, (function, numerical, filters), strict=True):
        name = name.replace(token, text)
    if not pivot:
        return name
    if "PIVOTVALUE" in name:
        return name.replace("PIVOTVALUE", str(pivot[1]))
    return name.replace("PIVOT", piece) if "PIVOT" in name else f"{name}_{piece}"


def plain_name(name: str) -> str:
    """A feature name without characters that clash in SQL: ``.`` is ``dot``, ``,`` is ``_``, round brackets are square, no quotes, no blanks."""
    return name.translate(str.maketrans({".": "dot", ",": "_", '"': None, "(": "[", ")": "]", " ": None}))
