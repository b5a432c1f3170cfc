"""Cut a text where byte-level pre-tokenization cannot look across.

A pre-token starts with at most one space, and a run of white space gives its last space to what follows.  So a
space that a character other than white space follows always starts a new pre-token, and what stands before it is cut
as if the text ended there.  Stretches between such spaces can be encoded and remembered on their own.
"""

from __future__ import annotations

import re

_INNER = re.compile(r" (?:\s|\Z)")
_SPLIT = re.compile(r" (?=\S)")


def stretches(text: str) -> list[str]:
    """The first stretch as it is; each of the others has lost the one space that it starts with."""
    if _INNER.search(text):
        return _SPLIT.split(text)
    return text.split(" ")
