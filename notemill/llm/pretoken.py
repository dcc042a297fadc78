"""Vectorised pre-tokenization of UTF-8 text for the two public BPE vocabularies.

Both tokenizers cut a text into pieces by a pattern over letters, numbers,
white space and the rest, then merge inside each piece. Here the cuts of a whole
batch are found with numpy, so that Python only ever sees each *different* piece
once. Texts with characters outside the table below (code points of 0x3000 and
more, combining marks, characters whose normal form differs, unassigned ones,
special-token strings) are cut by the tokenizers library.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

from notemill.llm.common import Texts

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Code points below this have table entries; the UTF-8 lead byte of the first one outside is 0xE3.
COVERED, FIRST_LEAD_OUTSIDE = 0x3000, 0xE3
#: White space as the patterns' \s has it.
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F]
#: Endings that both patterns split off after an apostrophe.
ENDINGS = [b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"]


@cache
def classes() -> tuple[np.ndarray, np.ndarray]:
    """Class of each code point, and whether the vectorised way may handle it."""
    kind, safe = np.zeros(COVERED, np.uint8), np.zeros(COVERED, bool)
    for cp in range(COVERED):
        c = chr(cp)
        category = unicodedata.category(c)
        kind[cp] = LETTER if category[0] == "L" else NUMBER if category[0] == "N" else OTHER
        safe[cp] = not (category in ("Cn", "Cs") or category[0] == "M" or unicodedata.combining(c) or unicodedata.normalize("NFC", c) != c or 0x1100 <= cp < 0x1200)
    kind[SPACES] = SPACE
    return kind, safe


class Chars:
    """Characters of the texts: where each starts, its code point and class; ``first`` marks where a text starts."""

    def __init__(self, texts: Texts):
        b = texts.data
        lead = (b & 0xC0) != 0x80
        self.at = np.flatnonzero(lead)
        head = b[self.at]
        cp = head.astype(np.int32)
        two, three = (head >= 0xC0) & (head < 0xE0), head >= 0xE0
        if two.any():
            p = self.at[two]
            cp[two] = ((b[p].astype(np.int32) & 0x1F) << 6) | (b[p + 1] & 0x3F)
        if three.any():
            p = self.at[three]
            cp[three] = ((b[p].astype(np.int32) & 0x0F) << 12) | ((b[p + 1].astype(np.int32) & 0x3F) << 6) | (b[p + 2] & 0x3F)
        self.cp, self.kind = cp, classes()[0][cp]
        self.first = np.zeros(len(cp) + 1, bool)
        self.first[np.searchsorted(self.at, texts.at)] = True


def unusual(texts: Texts, unsafe: np.ndarray, special: list[bytes]) -> np.ndarray:
    """Per text: whether it must go to the library as a whole."""
    out = np.zeros(len(texts), bool)
    b = texts.data
    high = np.flatnonzero(b >= FIRST_LEAD_OUTSIDE)
    out[np.searchsorted(texts.at, high, side="right") - 1] = True
    lead = np.flatnonzero((b >= 0xC2) & (b < FIRST_LEAD_OUTSIDE))
    if len(lead):
        head = b[lead].astype(np.int32)
        b1 = b[np.minimum(lead + 1, len(b) - 1)].astype(np.int32) & 0x3F
        b2 = b[np.minimum(lead + 2, len(b) - 1)].astype(np.int32) & 0x3F
        cp = np.where(head < 0xE0, ((head & 0x1F) << 6) | b1, ((head & 0x0F) << 12) | (b1 << 6) | b2)
        bad = lead[unsafe[np.minimum(cp, COVERED - 1)]]
        out[np.searchsorted(texts.at, bad, side="right") - 1] = True
    bar = np.flatnonzero((b[:-1] == ord("<")) & (b[1:] == ord("|"))) if len(b) > 1 else []
    for i in np.unique(np.searchsorted(texts.at, bar, side="right") - 1) if len(bar) else []:
        out[i] |= any(s in texts.row(i) for s in special)
    return out


def split_endings(starts: np.ndarray, chars: Chars) -> None:
    """Makes 's and its like pieces of their own where an apostrophe starts a piece. Changes ``starts``."""
    n = len(chars.cp)
    at = np.flatnonzero(starts[:n] & (chars.cp == ord("'")))
    at = at[at + 1 < n]
    taken = np.zeros(len(at), bool)
    for ending in ENDINGS:
        k = len(ending)
        ok = ~taken & (at + k < n)
        p = at[ok]
        for j, c in enumerate(ending):
            hit = (chars.cp[p + 1 + j] == c) & ~chars.first[p + 1 + j]
            ok[np.flatnonzero(ok)[~hit]] = False
            p = at[ok]
        starts[p + 1] = False
        after = p + k + 1
        after = after[(after < n)]
        starts[after[chars.kind[after] == LETTER]] = True
        taken |= ok


def word_pieces(texts: Texts) -> tuple[Texts, np.ndarray]:
    """Pieces of lower-cased texts for the vocabulary with word ends; white space is dropped.

    Returns the pieces and, per text, where its pieces start (one more entry at the end).
    """
    chars = Chars(texts)
    n = len(chars.cp)
    before = np.concatenate([[SPACE], chars.kind[:-1]]) if n else np.zeros(0, np.uint8)
    starts = (chars.kind != SPACE) & ((before != chars.kind) | (chars.kind == NUMBER) | chars.first[:n])
    split_endings(starts, chars)
    keep = np.repeat(chars.kind != SPACE, np.diff(np.append(chars.at, len(texts.data))))
    begin = chars.at[starts]
    shift = np.concatenate([[0], np.cumsum(keep)])
    pieces = Texts(texts.data[keep], np.append(shift[begin], shift[-1]).astype(np.int64))
    return pieces, np.searchsorted(begin, texts.at)


def byte_pieces(texts: Texts) -> tuple[Texts, np.ndarray]:
    """Pieces for the byte-level vocabulary: a space joins what follows it, other white space stands alone."""
    chars = Chars(texts)
    n = len(chars.cp)
    if not n:
        return Texts(texts.data, np.zeros(1, np.int64)), np.zeros(len(texts) + 1, np.int64)
    space = chars.kind == SPACE
    first, last = chars.first[:n], chars.first[1:]
    before = np.concatenate([[OTHER], chars.kind[:-1]])
    run = (before != chars.kind) | first
    blank_before = np.concatenate([[False], chars.cp[:-1] == 0x20]) & ~first
    starts = run & ~(blank_before & ~space)
    # the last white space before something else starts a piece: alone, or with what follows if it is a blank
    tail = space & ~last & ~np.concatenate([space[1:], [True]])
    starts |= tail
    split_endings(starts, chars)
    begin = chars.at[starts]
    return Texts(texts.data, np.append(begin, len(texts.data)).astype(np.int64)), np.searchsorted(begin, texts.at)
