"""Fill-in-middle: two cuts at token ends, and the three parts in another order.

The cuts of a text are drawn by its id as ranks among its tokens and looked up in the
text's learned rank index (``rank_index``). The marks make the parts findable again, so
``restore`` rebuilds the text from the output and its form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattframe.llm.rank_index import ERROR, RankIndex, text_bytes, token_ends
from wattframe.llm.scratch import tidy, whole_text
from wattframe.llm.words import text_slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per cent of the texts that are cut, and of these the share with the suffix first.
CUT_PERCENT = 50
SUFFIX_FIRST_PERCENT = 80

_FOUND = (
    T.StructField("n", T.LongType()),
    T.StructField("prefix_chars", T.LongType()),
    T.StructField("middle_chars", T.LongType()),
    T.StructField("output", T.StringType()),
)


def _draw(id_column: Column, seed: int, which: int) -> Column:
    """One of the eight 32-bit numbers that the seed and the id give."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit("")))
    part = F.substring(F.sha2(key, 256), 8 * which + 1, 8)
    return F.conv(part, 16, 10).cast("long")


def form_of(text: Column, id_column: Column, seed: int = 42) -> Column:
    """``plain``, ``psm`` or ``spm``; empty texts and those that hold a mark stay plain."""
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    stays = (text == "") | marked | (_draw(id_column, seed, 2) % 100 >= CUT_PERCENT)
    order = F.when(_draw(id_column, seed, 3) % 100 < SUFFIX_FIRST_PERCENT, "spm").otherwise("psm")
    return F.when(stays, "plain").otherwise(order)


def _transform(error: int):
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in text_slices(batch, "text"):
                data, offsets = text_bytes(some.column("text"))
                ends, counts = token_ends(data, offsets)
                starts_point = (data & 0xC0) != 0x80
                firsts = np.cumsum(counts) - counts
                draws = zip(some.column("h1").to_pylist(), some.column("h2").to_pylist(), some.column("form").to_pylist())
                prefixes, middles, outputs = [], [], []
                for i, (h1, h2, form) in enumerate(draws):
                    start, end, n = int(offsets[i]), int(offsets[i + 1]), int(counts[i])
                    if form == "plain":
                        prefixes.append(None)
                        middles.append(None)
                        outputs.append(data[start:end].tobytes())
                        continue
                    own = np.concatenate(([0], ends[firsts[i] : firsts[i] + n] - start))
                    index = RankIndex.fit(own, error)
                    a, b = (start + index.locate(r) for r in sorted((h1 % (n + 1), h2 % (n + 1))))
                    prefixes.append(int(np.count_nonzero(starts_point[start:a])))
                    middles.append(int(np.count_nonzero(starts_point[a:b])))
                    prefix, middle, suffix = data[start:a].tobytes(), data[a:b].tobytes(), data[b:end].tobytes()
                    p, s, m = marks
                    outputs.append(b"".join((p, prefix, s, suffix, m, middle) if form == "psm" else (s, suffix, p, prefix, m, middle)))
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("doc"),
                        some.column("form"),
                        pa.array(counts, pa.int64()),
                        pa.array(prefixes, pa.int64()),
                        pa.array(middles, pa.int64()),
                        pa.array(outputs, pa.binary()).cast(pa.string()),
                    ],
                    ["doc", "form", "n", "prefix_chars", "middle_chars", "output"],
                )

    return run


def fill_in_middle(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", seed: int = 42, error: int = ERROR
) -> DataFrame:
    """``(doc, form, n, prefix_chars, middle_chars, output)``, one row per document.

    ``doc`` is a struct of all columns but the text, whatever their names. A null text
    counts as empty, a null id as an id without digits; rows that repeat are cut alike.
    An empty table gives an empty one. A row's work depends on that row alone, so nothing
    is shuffled, and a lost task is run again with the same result.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_column]
    key = F.col(f"`{id_column}`")
    packed = docs.select(
        F.struct(*others).alias("doc"),
        whole_text(f"`{text_column}`").alias("text"),
        _draw(key, seed, 0).alias("h1"),
        _draw(key, seed, 1).alias("h2"),
        form_of(whole_text(f"`{text_column}`"), key, seed).alias("form"),
    )
    found = T.StructType([packed.schema["doc"], packed.schema["form"], *_FOUND])
    return packed.mapInArrow(tidy(_transform(error)), found)


def restore(output: Column, form: Column) -> Column:
    """The text that an output and its form were made from.

    A mark shares no beginning with its own end and no text that is cut holds one, so
    the first place where a mark is found is its own.
    """
    middle = F.substring_index(output, MIDDLE, -1)
    rest = F.substring_index(output, MIDDLE, 1)
    second = F.when(form == "psm", SUFFIX).otherwise(PREFIX)
    head = F.split_part(rest, second, F.lit(1)).substr(F.lit(len(PREFIX) + 1), F.length(rest))
    tail = F.split_part(rest, second, F.lit(2))
    parts = F.when(form == "psm", F.concat(head, middle, tail)).otherwise(F.concat(tail, middle, head))
    return F.when(form == "plain", output).otherwise(parts)
