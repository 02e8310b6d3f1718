"""Letters and scripts of code points, and words of letters."""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

from .wordhash import BLANK_SEPARATED, Words

# Unicode blocks by script.
RANGES = (
    ("latin", ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A))),
    ("greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F))),
    ("armenian", ((0x530, 0x58F),)),
    ("hebrew", ((0x590, 0x5FF), (0xFB1D, 0xFB4F))),
    ("arabic", ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))),
    ("devanagari", ((0x900, 0x97F), (0xA8E0, 0xA8FF))),
    ("bengali", ((0x980, 0x9FF),)),
    ("gurmukhi", ((0xA00, 0xA7F),)),
    ("gujarati", ((0xA80, 0xAFF),)),
    ("oriya", ((0xB00, 0xB7F),)),
    ("tamil", ((0xB80, 0xBFF),)),
    ("telugu", ((0xC00, 0xC7F),)),
    ("kannada", ((0xC80, 0xCFF),)),
    ("malayalam", ((0xD00, 0xD7F),)),
    ("sinhala", ((0xD80, 0xDFF),)),
    ("thai", ((0xE00, 0xE7F),)),
    ("lao", ((0xE80, 0xEFF),)),
    ("tibetan", ((0xF00, 0xFFF),)),
    ("myanmar", ((0x1000, 0x109F),)),
    ("georgian", ((0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F))),
    ("hangul", ((0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7FF))),
    ("ethiopic", ((0x1200, 0x139F), (0x2D80, 0x2DDF))),
    ("khmer", ((0x1780, 0x17FF),)),
    ("mongolian", ((0x1800, 0x18AF),)),
    ("kana", ((0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F))),
    ("han", ((0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))),
)
#: Names of the scripts; the last is that of all other letters.
SCRIPTS = (*(name for name, _ in RANGES), "other")
#: No code point from here on is a letter.
PLANES = 0x40000


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per code point: is it a letter, does it belong to words (letters and their marks),
    and its script."""
    letter, inside = np.zeros(PLANES + 1, bool), np.zeros(PLANES + 1, bool)
    script = np.full(PLANES + 1, len(RANGES), np.int64)
    for cp in range(PLANES):
        kind = unicodedata.category(chr(cp))[0]
        letter[cp], inside[cp] = kind == "L", kind in "LM"
    for k, (_, ranges) in enumerate(RANGES):
        for a, b in ranges:
            script[a : b + 1] = k
    return letter, inside, script


def code_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points that begin at the bytes ``at``; ``PLANES`` for those beyond."""
    byte = lambda k: data[np.minimum(at + k, len(data) - 1)].astype(np.int64) & 0x3F
    b = data[at].astype(np.int64)
    two = (b & 0x1F) << 6 | byte(1)
    three = (b & 0x0F) << 12 | byte(1) << 6 | byte(2)
    four = (b & 0x07) << 18 | byte(1) << 12 | byte(2) << 6 | byte(3)
    return np.minimum(np.where(b < 0x80, b, np.where(b < 0xE0, two, np.where(b < 0xF0, three, four))), PLANES)


_LETTERS = BLANK_SEPARATED.copy()
_LETTERS[:128] = False
_LETTERS[[*range(65, 91), *range(97, 123)]] = True


class LetterWords(Words):
    """Runs of letters with their marks: ``script`` of each, by its first code point, and
    ``lettered``, which texts have a letter at all."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        letter, inside, script = tables()
        leads = np.flatnonzero(data >= 0xC0)
        cps = code_points(data, leads) if len(leads) else leads
        out = leads[~inside[cps]]
        if len(out):
            data = data.copy()
            size = np.where(data[out] < 0xE0, 2, np.where(data[out] < 0xF0, 3, 4))
            for k in range(4):
                data[out[size > k] + k] = 0x20
        super().__init__(data, offsets, _LETTERS)
        self.script = script[code_points(self.bytes, self.start)] if len(self.start) else np.zeros(0, np.int64)
        at = np.concatenate((np.flatnonzero((self.bytes >= 97) & (self.bytes <= 122)), leads[letter[cps]]))
        self.lettered = np.bincount(np.searchsorted(offsets, at, "right") - 1, minlength=len(offsets) - 1)[: len(offsets) - 1] > 0
