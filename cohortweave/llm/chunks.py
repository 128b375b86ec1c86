"""Pieces of a text that a byte-level BPE pattern never joins, so that their ids can be kept."""

from __future__ import annotations

import re

_UNSAFE = re.compile(r"\s |^ ")
_CUT = re.compile(r"(?<=\S)(?= )")


def chunks(text: str) -> list[str]:
    """``text`` cut before every space that follows a character other than white space.

    No match of the pattern reaches over such a place: none of its alternatives has a space after
    another character than white space.
    """
    if not text:
        return []
    if _UNSAFE.search(text) or text[-1] == " ":
        return _CUT.split(text)
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]]
