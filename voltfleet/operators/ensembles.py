"""Tree ensembles as tables of nodes: what a forecaster does, as data that any SQL engine can walk, or as numpy arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml import Model, PipelineModel
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODE_DDL = "tree int, weight double, node int, feature int, name string, threshold double, left_node int, right_node int, value double"


def node_table(model: Model, inputs: list[str]) -> DataFrame:
    """A row per node of a fitted forest or boosted ensemble, in the order of a walk from each root, which is node 0.

    ``weight`` is the tree's share of the sum: its boosting weight, or one over the number of trees. Inner nodes send a row
    to ``left_node`` when the feature is at most ``threshold``. The table is as large as the model, whatever the data.
    """
    spark = SparkSession.active()
    trees = model.trees
    weights = list(model.treeWeights) if isinstance(model, GBTRegressionModel) else [1.0 / len(trees)] * len(trees)
    rows: list[tuple] = []
    for number, (tree, weight) in enumerate(zip(trees, weights, strict=True)):
        made: list[list] = []

        def visit(node, made: list[list] = made, number: int = number, weight: float = weight) -> int:
            own = len(made)
            made.append([number, float(weight), own, None, None, None, None, None, float(node.prediction())])
            if node.subtreeDepth() > 0:
                split = node.split()
                feature = int(split.featureIndex())
                made[own][3:6] = [feature, inputs[feature], float(split.threshold())]
                made[own][6] = visit(node.leftChild())
                made[own][7] = visit(node.rightChild())
            return own

        visit(tree._call_java("rootNode"))
        rows.extend(tuple(r) for r in made)
    return spark.createDataFrame(rows, NODE_DDL)


def _tree(nodes: dict[int, tuple], node: int) -> Column:
    _, name, threshold, left, right, value = nodes[node]
    if name is None:
        return F.lit(value)
    return F.when(F.col(name) <= threshold, _tree(nodes, left)).otherwise(_tree(nodes, right))


def predicted(rows: DataFrame, nodes: DataFrame, out: str) -> DataFrame:
    """Add the ensemble's prediction as ``out``: each tree is one nested condition, so rows are neither shuffled nor copied."""
    trees: dict[int, tuple[float, dict[int, tuple]]] = {}
    for r in nodes.collect():  # as large as the model
        trees.setdefault(r.tree, (r.weight, {}))[1][r.node] = (r.node, r.name, r.threshold, r.left_node, r.right_node, r.value)
    total = F.lit(0.0)
    for _, (weight, own) in sorted(trees.items()):
        total = total + weight * _tree(own, 0)
    return rows.withColumn(out, total)


def walk_sql(inputs: list[str], rows: str = "rows", nodes: str = "nodes") -> str:
    """SQL that walks every row of table ``rows`` (with a column ``row``) down every tree; ``walked`` has row and got."""
    value = " ".join(f"WHEN '{name}' THEN r.{name}" for name in inputs)
    return f"""WITH RECURSIVE walk AS (
      SELECT r.row, n.tree, n.weight, n.node, n.left_node, n.right_node, n.name, n.threshold, n.value FROM {rows} r, {nodes} n WHERE n.node = 0
      UNION ALL
      SELECT w.row, n.tree, n.weight, n.node, n.left_node, n.right_node, n.name, n.threshold, n.value
      FROM walk w JOIN {rows} r ON r.row = w.row
      JOIN {nodes} n ON n.tree = w.tree AND n.node = CASE WHEN CASE w.name {value} END <= w.threshold THEN w.left_node ELSE w.right_node END
      WHERE w.name IS NOT NULL),
    walked AS (SELECT row, sum(weight * value) AS got FROM walk WHERE name IS NULL GROUP BY row)"""


@dataclass(frozen=True)
class Walker:
    """A fitted ensemble as arrays, all trees one after the other. A leaf leads to itself, so every row takes ``depth`` steps."""

    inputs: tuple[str, ...]
    roots: np.ndarray
    weights: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(rows), len(self.roots)))
        each = np.arange(len(rows))[:, None]
        for _ in range(self.depth):
            at = np.where(rows[each, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.value[at] @ self.weights


@dataclass(frozen=True)
class Line:
    """A fitted linear model."""

    inputs: tuple[str, ...]
    slopes: np.ndarray
    intercept: float

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        return rows @ self.slopes + self.intercept


def compiled(pipeline: PipelineModel) -> Walker | Line:
    """An assembler and a regression model as one function over a matrix with a column per name in ``inputs``."""
    assembler, model = pipeline.stages
    inputs = tuple(assembler.getInputCols())
    if not hasattr(model, "trees"):
        return Line(inputs, np.array(model.coefficients.toArray()), float(model.intercept))
    nodes = node_table(model, list(inputs)).toPandas()  # as large as the model
    base = nodes.groupby("tree")["node"].transform("size").groupby(nodes["tree"]).first().cumsum().shift(fill_value=0)
    first = nodes["tree"].map(base).to_numpy()
    own = first + nodes["node"].to_numpy()
    order = np.argsort(own)
    nodes, first, own = nodes.iloc[order], first[order], own[order]
    leaf = nodes["feature"].isna().to_numpy()

    def child(name: str) -> np.ndarray:
        return np.where(leaf, own, first + nodes[name].fillna(0).to_numpy().astype(int))

    trees = nodes[nodes["node"] == 0]
    return Walker(
        inputs,
        own[(nodes["node"] == 0).to_numpy()],
        trees["weight"].to_numpy(),
        nodes["feature"].fillna(0).to_numpy().astype(int),
        nodes["threshold"].fillna(0.0).to_numpy(),
        child("left_node"),
        child("right_node"),
        nodes["value"].to_numpy(),
        max(t.depth for t in model.trees),
    )
