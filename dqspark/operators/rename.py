"""Column renames, decided from names alone.

A rename is a function from the names of a table to new names.  Spark looks names
up without case, so two names that differ by case only are the same name here.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from itertools import chain, count


def snake(name: str) -> str:
    """Punctuation dropped, spaces to underscores, lower case."""
    return "_".join(re.sub(r"[^\w\s]", "", name).split()).lower()


STYLES: dict[str, Callable[[str], str]] = {
    "none": lambda name: name,
    "snake": snake,
    "lower": lambda name: name.strip().lower(),
}


class _Owners:
    """Who has which name; a wanted name that another column has is numbered."""

    def __init__(self, columns: list[str]) -> None:
        self.owner = {c.lower(): c for c in columns}
        self.spellings: dict[str, Iterator[str]] = {}

    def claim(self, column: str, wanted: str) -> str:
        numbered = self.spellings.setdefault(wanted, chain([wanted], (f"{wanted}_{i}" for i in count(2))))
        for name in numbered:  # goes on where the last claim of this name stopped
            if self.owner.setdefault(name.lower(), column) == column:
                return name
        raise AssertionError("numbers do not end")


def plan_renames(columns: list[str], style: str = "none",
                 manual: Mapping[str, str] | None = None) -> dict[str, str]:
    """Old name to new name, for the columns whose name changes.

    A name given by hand goes before the style's.  Of columns that want the same
    name, or one that a column of the table has, the later ones get ``_2``, ``_3``
    and so on.
    """
    by_hand = {old: new.strip() for old, new in (manual or {}).items()
               if old in columns and new.strip() not in ("", old)}
    styled = {} if style not in STYLES or style == "none" else {c: STYLES[style](c) for c in columns}
    owners = _Owners(columns)
    return {old: owners.claim(old, new) for old, new in (styled | by_hand).items() if new != old}


def compose(earlier: Mapping[str, str], later: Mapping[str, str]) -> dict[str, str]:
    """The rename that does ``earlier`` and then ``later``, as original to final names.

    A name that ``earlier`` gave away or brought in is no original name of its own.
    """
    originals = [*earlier, *(later.keys() - earlier.keys() - set(earlier.values()))]
    ends = ((name, later.get(earlier.get(name, name), earlier.get(name, name))) for name in originals)
    return {name: end for name, end in ends if name != end}
