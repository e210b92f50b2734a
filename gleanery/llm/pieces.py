"""Splitting texts into the pieces that byte-pair merges never cross, exactly as the tokenizers library does.

Texts made of the characters below are split here with the standard ``re`` module; their classes under the library's
Unicode tables are spelled out. A text with any other character, or with a special token's marker, is left to the
library as a whole. Encoding a piece alone gives the ids it has inside a text.
"""

from __future__ import annotations

import os
import re
from functools import cache

from tokenizers import Tokenizer

#: Letters, numbers and white space among the characters of plain texts (Latin-1 and general punctuation).
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
NUMBERS = "0-9²³¹¼½¾"
SPACES = " \t\n\r\x0b\x0c"
_PLAIN = re.compile("[\x00-\x7f¡-¬®-ÿ‐-‧‰-⁞€]*")
#: The contractions that both vocabularies keep together.
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
#: A run of letters never starts with an apostrophe, so trying it before the contractions changes nothing.
WORDS = re.compile(f"[{LETTERS}]+|[{NUMBERS}]|{_SHORT}|[^{SPACES}{LETTERS}{NUMBERS}]+")


def plain(text: str) -> bool:
    """ASCII texts are told at once: a string knows whether it is ASCII."""
    return "<|" not in text and (text.isascii() or _PLAIN.fullmatch(text) is not None)


@cache
def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a file, once in each Python worker, without truncation or padding. Spark's tasks are the
    parallelism: threads of the library's own would only add memory."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def slices(sizes, limit: int):
    """(from, to) ranges of consecutive items whose sizes sum up to about ``limit``."""
    start = total = end = 0
    for end, n in enumerate(sizes, 1):
        total += n
        if total >= limit:
            yield start, end
            start, total = end, 0
    if start < end:
        yield start, end
