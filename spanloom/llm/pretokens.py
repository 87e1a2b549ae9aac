"""Splitting text into the pieces whose bytes are merged separately."""

from __future__ import annotations

import re
from collections.abc import Callable

import regex

# The character classes of the public pattern, written out for
# texts in Latin-1 without superscript digits, fractions and separators U+001C-1F.
_LATIN = re.compile("[\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\xff]*")
_LETTER, _SPACE = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "\t-\r \x85\xa0"
_FAST = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^{_SPACE}{_LETTER}0-9]+"
    f"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)


def splitter(pattern: str, latin_form: bool = True) -> Callable[[str], list[str]]:
    """A function giving all matches of pattern; Latin texts take an equal pattern of the quicker library."""
    whole = regex.compile(pattern)

    def split(text: str) -> list[str]:
        if latin_form and _LATIN.fullmatch(text):
            return _FAST.findall(text)
        return whole.findall(text)

    return split
