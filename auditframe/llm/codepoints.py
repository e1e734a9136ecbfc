"""Classes of code points as one flat array, and texts as code point arrays."""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np

from auditframe.session import ship_with_tasks

ship_with_tasks(__name__)

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
# The code points of the Unicode property White_Space.
WHITE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@functools.cache
def general_classes() -> np.ndarray:
    """LETTER for categories L*, NUMBER for N*, SPACE for White_Space, else OTHER; one byte a code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(x))[0], OTHER) for x in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    table[list(WHITE)] = SPACE
    return table


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
