"""Keyword vocabularies: ordered token ids, the tokenizing pattern, the boundary token."""

from __future__ import annotations

import re
import string
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The keywords of each dialect, in the order that ids of equal length follow.
_LETTERS, _DIGITS = list(string.ascii_lowercase), list(string.digits)
_COMMON = [";", "?", "@", "^", "$", "\n#STEP\n", "\n", "\t", "\n\n", *_LETTERS, *_DIGITS, "=", "+", "-", ":", "if", "<", ">"]
_LEGACY = [
    "# ", "&", ";", "?", "|", "@", "^", "$", "# output\n", "# code\n", "\n#STEP\n", "\n", "\t", "\n\n", *_LETTERS, *_DIGITS,
    "for", "in", "range(", "while", "=", "+", "-", "/", "*", "%", "//", "(", ")", ":", ",", ".",
    "if", "elif", "else", "==", "<", "<=", ">", ">=", "not", "!=", "print(",
]


@dataclass(frozen=True)
class Vocabulary:
    """Longer keywords come first and have smaller ids; boundary must be one of them."""

    keywords: tuple[str, ...]
    boundary: str = "\n#STEP\n"

    @classmethod
    def of(cls, words: list[str], boundary: str = "\n#STEP\n") -> Vocabulary:
        if boundary not in words:
            raise ValueError(f"the boundary {boundary!r} is not a keyword")
        return cls(tuple(sorted(words, key=len, reverse=True)), boundary)

    @property
    def ids(self) -> dict[str, int]:
        return {k: i for i, k in enumerate(self.keywords)}

    @property
    def pattern(self) -> str:
        """Any keyword, longest first, else one character that isn't a space; the latter covers keywords of one character."""
        return "|".join(re.escape(k).replace("\\\n", "\n").replace("\\\t", "\t").replace("\\ ", " ").replace("\\#", "#").replace("\\&", "&") for k in self.keywords if len(k) > 1) + "|[^ ]"

    def id_map(self) -> Column:
        return F.create_map(*(F.lit(x) for kv in self.ids.items() for x in kv))


BASE = Vocabulary.of(_COMMON)
LOOPS = Vocabulary.of([*_COMMON, "for", "in", "range", "(", ")"])
LEGACY = Vocabulary.of(_LEGACY, "# code\n")
