"""A forest as a table of nodes, evaluated by column expressions.

A trained forest is exported to rows, one for each node, that hold all a prediction
needs: the input column, how it is scaled, the threshold, the children, the value. The
table is bounded by the trees and their depth. Scoring reads it as a one-row subquery
and walks each tree with array functions, so no vectors and no Python are involved and
the scored rows are not shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE_SCHEMA = (
    "tree int, node int, input string, shift double, scale double, threshold double, left int, right int, value double"
)


def nodes_of(stored: DataFrame, inputs: Sequence[str], scaling: dict[str, tuple[float, float]]) -> DataFrame:
    """Nodes of a stored MLlib forest, whose trees number their nodes in order from 0.

    ``scaling`` gives each input's shift and scale. A leaf has no input.
    """
    columns = [
        F.struct(F.lit(c).alias("input"), F.lit(scaling[c][0]).alias("shift"), F.lit(scaling[c][1]).alias("scale")) for c in inputs
    ]
    node = F.col("nodeData")
    inner = node["leftChild"] >= 0
    own = F.when(inner, F.get(F.array(*columns), node["split"]["featureIndex"]))
    return stored.select(
        F.col("treeID").cast("int").alias("tree"),
        node["id"].alias("node"),
        own["input"].alias("input"),
        own["shift"].alias("shift"),
        own["scale"].alias("scale"),
        F.when(inner, F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0))).alias("threshold"),
        node["leftChild"].alias("left"),
        node["rightChild"].alias("right"),
        node["prediction"].alias("value"),
    )


def _walked(tree: Column, given: Column, depth: int) -> Column:
    """Value of the leaf that the inputs lead to in a tree."""

    def step(at: Column, _: Column) -> Column:
        node = F.get(tree, at)
        scaled = (F.get(given, node["place"]) - node["shift"]) / node["scale"]
        below = F.when(scaled <= node["threshold"], node["left"]).otherwise(node["right"])
        return F.when(node["place"].isNull(), at).otherwise(below)

    leaf = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step)
    return F.get(tree, leaf)["value"]


def as_arrays(nodes: DataFrame, inputs: Sequence[str]) -> DataFrame:
    """One row: the trees by their numbers, each an array of its nodes by theirs."""
    place = F.array_position(F.array(*map(F.lit, inputs)), F.col("input"))
    node = F.struct(
        "node",
        F.when(F.col("input").isNotNull(), (place - 1).cast("int")).alias("place"),
        "shift",
        "scale",
        "threshold",
        "left",
        "right",
        "value",
    )
    trees = nodes.groupBy("tree").agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    return trees.agg(F.transform(F.array_sort(F.collect_list(F.struct("tree", "nodes"))), lambda t: t["nodes"]).alias("forest"))


def _predicted(rows: DataFrame, nodes: DataFrame, inputs: Sequence[str], depth: int, into: str) -> DataFrame:
    given = F.array(*(F.col(c).cast("double") for c in inputs))
    values = F.transform("_forest", lambda tree: _walked(tree, F.col("_given"), depth))
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size("_forest")
    held = rows.withColumns({"_forest": as_arrays(nodes, inputs).scalar(), "_given": given})
    return held.withColumn(into, F.when(F.forall("_given", lambda x: x.isNotNull()), mean)).drop("_forest", "_given")


def score(
    rows: DataFrame, nodes: DataFrame, inputs: Sequence[str], depth: int, by: Sequence[str] | None = None, into: str = "prediction"
) -> DataFrame:
    """Rows with their prediction, the mean over the trees of the leaves their inputs lead to.

    ``depth`` is that of the deepest tree or more. Nodes are used by their numbers,
    which have to run from 0 in each tree; trees are added up by their numbers. A row
    with a null input has a null prediction. With ``by`` the inputs follow from a few
    values, such as the calendar's: each combination is scored once and brought to
    the rows by a join.
    """
    if by is None:
        return _predicted(rows, nodes, inputs, depth, into)
    once = _predicted(rows.select(*{*inputs, *by}).distinct(), nodes, inputs, depth, into)
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in by]
    return rows.alias("r").join(once.alias("o"), same, "left").select("r.*", f"o.{into}")
