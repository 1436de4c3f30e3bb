"""Line de-duplication by a tree of log templates.

Lines go down a tree of fixed depth: first by the number of their tokens, then by
their leading tokens, tokens with a digit counting as variable. Within a leaf that
lines of enough documents reach, a token is constant at its place if it stands there
in enough documents, and variable otherwise; a line with its variable fields made
general is its template. Templates that recur across documents are dropped.

Documents with equal texts count as one, so that copies alone make nothing recur.
Everything is counted by keys that are combined before the shuffle; no group of
lines is ever gathered. Only lines in recurring leaves are looked at token by token.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.llm.scratch import Scratch, columns_of, whole_text

#: Leading tokens that the tree branches on, below the number of tokens.
DEPTH = 3
#: Different texts that a template has to occur in.
MIN_TEXTS = 5
#: Shorter lines say too little to be called a template.
MIN_TOKENS = 3
#: Share of a template's tokens that must be constant.
MIN_CONSTANT = 0.6

_VARIABLE = "<*>"
_SAME = ("h1", "h2")  # 128 bits of the text stand for it


def _tokens(line: Column) -> Column:
    """Tokens of a line; a blank line has one empty token.

    Most lines have single blanks only and are cut at those, without a pattern.
    """
    odd = [F.contains(line, F.lit(c)) for c in ("  ", "\t", "\r", "\f", "\x0b")]
    several = reduce(or_, odd, F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" ")))
    trimmed = F.btrim(line, F.lit(" \t\r\f\x0b"))
    return F.when(several, F.split(trimmed, r"[ \t\r\f\x0B]+")).otherwise(F.split(line, " "))


def _general(tokens: Column) -> Column:
    """Tokens with the variable ones made general."""
    return F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), F.lit(_VARIABLE)).otherwise(t))


def _recurring(df: DataFrame, min_texts: int, *by: str) -> DataFrame:
    """Keys that occur in enough different texts."""
    return df.select(*by, *_SAME).distinct().groupBy(*by).count().where(F.col("count") >= min_texts).drop("count")


def drop_recurring_lines(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    depth: int = DEPTH,
    min_texts: int = MIN_TEXTS,
    min_tokens: int = MIN_TOKENS,
    min_constant: float = MIN_CONSTANT,
) -> DataFrame:
    """One row per input row: its id, ``n_lines``, ``n_dropped`` and ``text``, the lines that stay.

    Lines end at line feeds; lines of fewer than ``min_tokens`` tokens stay, blank
    ones too. A null or empty text is one empty line. Repeated rows and rows without
    an id are treated alike. An empty table gives an empty one. Other columns are not
    read.
    """
    scratch = Scratch(docs.sparkSession, "line-templates")
    texts = columns_of(docs, id_column, text_column).select(
        F.col(id_column).alias("id"), whole_text(text_column).alias("text")
    )
    texts = texts.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})
    # exploding an array of one keeps the filter above the cutting, which is then done once
    lines = (
        texts.select(*_SAME, F.posexplode(F.split("text", "\n")).alias("line", "body"))
        .select(*_SAME, "line", F.explode(F.array(_tokens(F.col("body")))).alias("tokens"))
        .where((F.size("tokens") >= min_tokens) & (F.element_at("tokens", 1) != ""))
        .withColumn(
            "leaf",
            F.concat_ws(" ", F.size("tokens").cast("string"), _general(F.slice("tokens", 1, depth))),
        )
    )
    leaves = scratch.keep(_recurring(lines, min_texts, "leaf"))
    reached = scratch.keep(
        lines.join(leaves, "leaf").select(*_SAME, "line", "leaf", _general(F.col("tokens")).alias("tokens")).distinct()
    )
    fields = reached.select(*_SAME, "line", "leaf", F.posexplode("tokens").alias("place", "token"))
    constant = scratch.keep(_recurring(fields.where(F.col("token") != _VARIABLE), min_texts, "leaf", "place", "token"))
    marked = fields.join(constant.withColumn("constant", F.lit(True)), ["leaf", "place", "token"], "left")
    field = F.struct("place", F.when(F.col("constant"), F.col("token")).otherwise(_VARIABLE).alias("token"))
    templates = scratch.keep(
        marked.groupBy(*_SAME, "line", "leaf")
        .agg(F.sort_array(F.collect_list(field)).alias("fields"), F.avg(F.when(F.col("constant"), 1).otherwise(0)).alias("share"))
        .where(F.col("share") >= min_constant)
        .select(*_SAME, "line", "leaf", F.concat_ws(" ", "fields.token").alias("template"))
    )
    recurring = scratch.keep(_recurring(templates, min_texts, "leaf", "template"))
    dropped = scratch.keep(
        templates.join(recurring, ["leaf", "template"]).groupBy(*_SAME).agg(F.collect_set("line").alias("dropped"))
    )
    scratch.drop(leaves, reached, constant, templates, recurring)
    all_lines = F.split("text", "\n")
    places = F.sequence(F.lit(0), F.size("lines") - 1)
    return (
        # what is dropped grows with the documents: one plan at every size
        texts.join(dropped.hint("merge"), list(_SAME), "left")
        .select("id", all_lines.alias("lines"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))
        .select(
            F.col("id").alias(id_column),
            F.size("lines").cast("long").alias("n_lines"),
            F.size("dropped").cast("long").alias("n_dropped"),
            F.array_join(
                F.transform(F.array_except(places, "dropped"), lambda i: F.get("lines", i)), "\n"
            ).alias("text"),
        )
    )
