"""A fitted tree ensemble as a table of nodes (H6), and predictions by joins.

The table is data: it can be written, queried, and evaluated by any engine
that joins.  Its size depends on the model only, at most trees x
2^(depth + 1) rows, which is what is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = ("tree int, node int, depth int, feature int, threshold double, if_below int, if_above int, value double")


def node_table(model: GBTRegressionModel) -> DataFrame:
    """(tree, node, depth, feature, threshold, if_below, if_above, value).  An
    inner node sends a row to ``if_below`` when its feature is at or below the
    threshold (a split by categories of a 0/1 feature: threshold 0.5), a leaf
    has ``value``, the tree's weight applied, and no feature.  Node 0 is the root."""
    rows = []
    for t, (tree, weight) in enumerate(zip(model.trees, model.treeWeights)):
        waiting, made = [(tree._java_obj.rootNode(), 0, 0)], 1
        while waiting:
            node, number, depth = waiting.pop()
            if not _inner(node):
                rows.append((t, number, depth, None, None, None, None, float(node.prediction()) * float(weight)))
                continue
            split, low, high = node.split(), made, made + 1
            made += 2
            waiting += [(node.leftChild(), low, depth + 1), (node.rightChild(), high, depth + 1)]
            if split.getClass().getSimpleName() == "ContinuousSplit":
                threshold = float(split.threshold())
            else:
                left = {float(c) for c in split.leftCategories()}
                if not left | {float(c) for c in split.rightCategories()} <= {0.0, 1.0}:
                    raise ValueError("a split by categories of a feature other than 0/1")
                threshold = 0.5
                if 0.0 not in left:
                    low, high = high, low
            rows.append((t, number, depth, int(split.featureIndex()), threshold, low, high, None))
    return SparkSession.getActiveSession().createDataFrame(rows, NODES)


def _inner(node) -> bool:
    return node.getClass().getSimpleName() == "InternalNode"


def predict(df: DataFrame, nodes: DataFrame, keys: Sequence[str], features: str = "features", depth: int | None = None) -> DataFrame:
    """(keys, prediction) of rows with a feature vector: every row stands at
    the root of every tree and one join a level moves it down; the leaves'
    values add up by row.  ``depth``: levels to go, the table's own by default."""
    last = nodes.agg(F.max("depth"), F.max("tree")).first()
    if last[0] is None:
        raise ValueError("a model without trees")
    depth = last[0] if depth is None else depth
    nodes = F.broadcast(nodes.drop("depth"))
    roots = F.explode(F.sequence(F.lit(0), F.lit(last[1])))
    at = df.select(*keys, vector_to_array(features).alias("_x"), roots.alias("tree")).withColumn("node", F.lit(0))
    for _ in range(depth):
        below = F.get("_x", F.col("feature")) <= F.col("threshold")
        onward = F.when(F.col("feature").isNull(), F.col("node")).when(below, F.col("if_below")).otherwise(F.col("if_above"))
        at = at.join(nodes, ["tree", "node"]).select(*keys, "_x", "tree", onward.alias("node"))
    return at.join(nodes, ["tree", "node"]).groupBy(*keys).agg(F.sum("value").alias("prediction"))
