"""A stable pseudo-random order for splits and samples.

MD5 is used because it gives the same text in every engine, so a split can be
recomputed elsewhere. The keys are uniform, hence free of hot prefixes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEX = 16


def shuffle_key(*parts: Column, seed: int | str = 42) -> Column:
    """32 hex digits that order rows pseudo-randomly."""
    return F.md5(F.concat_ws("|", *(p.cast("string") for p in parts), F.lit(str(seed))))


def keep_share(key: Column, share: float) -> Column:
    """True for about ``share`` of the keys."""
    if share >= 1.0:
        return F.lit(True)
    return F.substring(key, 1, 8) < F.lit(f"{int(share * _HEX**8):08x}")


def pick(key: Column, count: int) -> Column:
    """A stable choice 0..count-1 from the ninth hex digit onwards."""
    return F.conv(F.substring(key, 9, 4), _HEX, 10).cast("int") % F.lit(count)
