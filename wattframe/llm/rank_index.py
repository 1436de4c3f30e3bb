"""A learned index from a token's rank in a text to the offset where the token ends.

The offsets are fitted by line segments that miss none of them by more than a given
error, and what a line misses is stored as a residual of one byte. A cut is looked up
by its rank: the segment is found by its first rank, the line predicts the offset, and
the residual corrects it exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes a line may miss an offset by; one more stays within a residual of one byte.
ERROR = 60
_FIRST_WINDOW = 256


def is_white(data: np.ndarray) -> np.ndarray:
    """Which bytes are a blank or one of the controls from tab to carriage return."""
    return (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after another, and the offsets of the texts in them."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def token_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the tokens of all texts end, and how many tokens each text has.

    A token is a word with the white space before it; white space after the last
    word is a token of its own. Every byte of a text belongs to one token.
    """
    white = is_white(data)
    last = np.zeros(len(data), bool)
    last[offsets[1:][np.diff(offsets) > 0] - 1] = True
    before_white = np.empty(len(data), bool)
    before_white[:-1], before_white[-1:] = white[1:], True
    ends = np.flatnonzero(last | (~white & before_white)) + 1
    return ends, np.diff(np.searchsorted(ends, offsets, side="right"))


@dataclass(frozen=True)
class RankIndex:
    """Line segments over the ranks 0 to n, and one residual for each rank."""

    ranks: np.ndarray
    bases: np.ndarray
    slopes: np.ndarray
    residuals: np.ndarray

    @staticmethod
    def _predict(base, slope, steps):
        return np.rint(base + slope * steps).astype(np.int64)

    @classmethod
    def fit(cls, offsets: np.ndarray, error: int = ERROR) -> RankIndex:
        """Segments as long as one line from their first offset serves all of them.

        The slopes that serve the offsets so far are an interval that narrows with
        every offset; a segment ends where nothing is left of it.
        """
        ranks, slopes = [], []
        at, window = 0, _FIRST_WINDOW
        while at < len(offsets):
            some = offsets[at : at + window]
            steps = np.arange(1, len(some))
            rise = some[1:] - some[0]
            high = np.minimum.accumulate((rise + error) / steps)
            low = np.maximum.accumulate((rise - error) / steps)
            empty = high < low
            served = int(np.argmax(empty)) if empty.any() else len(steps)
            if served == len(steps) and at + window < len(offsets):
                window *= 2
                continue
            ranks.append(at)
            slopes.append((high[served - 1] + low[served - 1]) / 2 if served else 0.0)
            at += served + 1
            window = _FIRST_WINDOW
        first = np.array(ranks, np.int64)
        slope = np.array(slopes)
        lengths = np.diff(np.append(first, len(offsets)))
        steps = np.arange(len(offsets)) - np.repeat(first, lengths)
        guess = cls._predict(np.repeat(offsets[first], lengths), np.repeat(slope, lengths), steps)
        return cls(first, offsets[first], slope, (offsets - guess).astype(np.int8))

    def locate(self, rank: int) -> int:
        """The offset after ``rank`` tokens."""
        at = int(np.searchsorted(self.ranks, rank, side="right")) - 1
        return int(self._predict(self.bases[at], self.slopes[at], rank - self.ranks[at])) + int(self.residuals[rank])
