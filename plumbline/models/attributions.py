"""Tree attributions: exact Shapley values of the path-dependent expectation.

A leaf contributes its value times a product over the features on its path: 1 where the row falls inside the
leaf's interval of that feature, otherwise the share of training rows that went the leaf's way. Shapley values
of such a product have a closed form in elementary polynomials, evaluated per leaf for a whole Arrow batch.
Model size (trees x leaves) is all that is shipped to the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F


def _leaf_rules(node, scale: float, path: dict, out: list) -> None:
    """Walk one fitted tree: per leaf its scaled value and {feature: (low, high, share)}."""
    if node.numDescendants() == 0:
        out.append((scale * node.prediction(), dict(path)))
        return
    split = node.split()
    feature, cut = split.featureIndex(), split.threshold()
    total = node.impurityStats().count()
    for child, left in ((node.leftChild(), True), (node.rightChild(), False)):
        low, high, share = path.get(feature, (-math.inf, math.inf, 1.0))
        kept = child.impurityStats().count() / total
        bounds = (low, min(high, cut)) if left else (max(low, cut), high)
        _leaf_rules(child, scale, {**path, feature: (*bounds, share * kept)}, out)


def leaf_rules(model: PipelineModel) -> list:
    """Leaves of the boosted model at the end of the pipeline."""
    last, rules = model.stages[-1], []
    java = last._java_obj
    for weight, tree in zip(last.treeWeights, java.trees()):
        _leaf_rules(tree.rootNode(), weight, {}, rules)
    return rules


def base_value(rules: list) -> float:
    return sum(v * math.prod(share for _, _, share in path.values()) for v, path in rules)


def attribute(rules: list, x: np.ndarray) -> np.ndarray:
    """Attributions (rows x features) of the margin."""
    phi = np.zeros_like(x)
    for value, path in rules:
        m = len(path)
        if not m:
            continue
        inside = {f: ((x[:, f] > low) & (x[:, f] <= high)).astype(float) for f, (low, high, _) in path.items()}
        weights = [math.factorial(s) * math.factorial(m - s - 1) / math.factorial(m) for s in range(m)]
        for j, (_, _, share) in path.items():
            coefficients = [np.ones(len(x))]
            for i, (_, _, z) in path.items():
                if i != j:
                    grown = [z * c for c in coefficients] + [np.zeros(len(x))]
                    for d, c in enumerate(coefficients):
                        grown[d + 1] = grown[d + 1] + inside[i] * c
                    coefficients = grown
            phi[:, j] += value * (inside[j] - share) * sum(w * c for w, c in zip(weights, coefficients))
    return phi


def tree_attributions(model: PipelineModel, df: DataFrame, features: Sequence[str], row_id: str) -> DataFrame:
    """(row_id, attributions): one (feature, contribution) entry per feature, plus `base_value`."""
    rules = leaf_rules(model)
    shared = df.sparkSession.sparkContext.broadcast(rules)
    names = list(features)
    outputs = [f"_phi{i}" for i in range(len(names))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            phi = attribute(shared.value, batch[names].to_numpy(float))
            yield pd.DataFrame({row_id: batch[row_id], **{o: phi[:, i] for i, o in enumerate(outputs)}})

    kind = df.schema[row_id].dataType.simpleString()
    schema = f"{row_id} {kind}, " + ", ".join(f"{o} double" for o in outputs)
    wide = df.select(row_id, *[F.col(c).cast("double").alias(c) for c in names]).mapInPandas(run, schema)
    entries = [F.struct(F.lit(n).alias("feature"), F.col(o).alias("contribution")) for n, o in zip(names, outputs)]
    return wide.select(row_id, F.array(*entries).alias("attributions"), F.lit(base_value(rules)).alias("base_value"))
