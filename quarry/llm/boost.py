"""Gradient-boosted trees fitted and applied with DataFrame aggregations only.

Features are cut into bins at training quantiles.  Each level of each tree is
one aggregation of gradients by (node, feature, bin); the driver sees only that
histogram (at most 2^depth x features x bins rows) and picks the splits.  A
fitted model is a list of nested WHEN expressions, so scoring stays in generated
code and needs no shuffle.

Defined results: ties between splits go to the first feature and lowest bin;
null features compare as 0; repeated rows count as often as they occur; a
training set without both classes gives the constant log-odds of its labels.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Boosted:
    features: list[str]
    base: float
    trees: list[dict] = field(default_factory=list)

    def raw(self) -> Column:
        """Log-odds from columns named as the features."""
        total = F.lit(self.base)
        for t in self.trees:
            total = total + _apply(t, self.features)
        return total

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-self.raw()))


def _apply(node: dict, names: list[str]) -> Column:
    if "leaf" in node:
        return F.lit(node["leaf"])
    return F.when(F.coalesce(F.col(names[node["feature"]]), F.lit(0.0)) <= node["cut"], _apply(node["left"], names)).otherwise(_apply(node["right"], names))


def _open_leaves(node: dict, names: list[str]) -> Column:
    """The number of the leaf a row falls in, for leaves that carry one; else null."""
    if "leaf" in node:
        return F.lit(node.get("number")).cast("int")
    return F.when(F.coalesce(F.col(names[node["feature"]]), F.lit(0.0)) <= node["cut"], _open_leaves(node["left"], names)).otherwise(_open_leaves(node["right"], names))


def fit(rows: DataFrame, features: list[str], label: str = "label", trees: int = 12, depth: int = 3, rate: float = 0.4, bins: int = 16, ridge: float = 1.0) -> Boosted:
    """rows: a labelled set of bounded size (the caller bounds it), label 0 or 1."""
    at = [i / bins for i in range(1, bins)]
    cuts_row = rows.agg(*[F.percentile_approx(F.coalesce(f, F.lit(0.0)), at, 10000).alias(f) for f in features]).first()
    cuts = [sorted(set(cuts_row[f] or [])) for f in features]
    # The bounded set shrinks once more to its distinct binned rows.
    binned = [F.coalesce(F.col(f), F.lit(0.0)) for f in features]
    snapped = [
        F.coalesce(*[F.when(x <= c, F.lit(float(c))) for c in cs], F.lit(math.inf)) if cs else F.lit(math.inf) for x, cs in zip(binned, cuts, strict=True)
    ]
    small = rows.select(*[s.alias(f) for s, f in zip(snapped, features, strict=True)], F.col(label).cast("double").alias("y")).groupBy(*features, "y").agg(F.count("*").alias("n")).cache()
    sums = small.agg(F.sum(F.col("y") * F.col("n")).alias("pos"), F.sum("n").alias("n")).first()
    n, pos = float(sums["n"] or 0), float(sums["pos"] or 0)
    model = Boosted(features, math.log((pos + 0.5) / (n - pos + 0.5)))
    if 0 < pos < n:
        for _ in range(trees):
            model.trees.append(_grow(small, model, cuts, depth, rate, ridge))
    small.unpersist()
    return model


def _grow(small: DataFrame, model: Boosted, cuts: list[list[float]], depth: int, rate: float, ridge: float) -> dict:
    p = 1 / (1 + F.exp(-model.raw()))
    graded = small.select(*model.features, ((F.col("y") - p) * F.col("n")).alias("g"), (p * (1 - p) * F.col("n")).alias("h"))
    root: dict = {"leaf": 0.0, "number": 0}
    leaves = {0: root}
    for level in range(depth + 1):
        if not leaves:
            break
        seen = graded.withColumn("node", _open_leaves(root, model.features)).where("node IS NOT NULL")
        cells = seen.select("node", "g", "h", F.posexplode(F.array(*model.features)).alias("feature", "bin")).groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        grid: dict[int, dict[int, dict[float, tuple[float, float]]]] = {}
        for r in cells.collect():
            grid.setdefault(r["node"], {}).setdefault(r["feature"], {})[r["bin"]] = (r["g"], r["h"])
        following = {}
        for number, node in leaves.items():
            of = grid.get(number, {})
            if not of:
                continue
            g, h = (sum(x[i] for x in of[0].values()) for i in (0, 1))
            node["leaf"] = rate * g / (h + ridge)
            best = (1e-6, None, None)
            for f in sorted(of) if level < depth else []:
                gl = hl = 0.0
                for c in cuts[f]:
                    gl, hl = gl + of[f].get(c, (0, 0))[0], hl + of[f].get(c, (0, 0))[1]
                    gain = gl * gl / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g * g / (h + ridge)
                    if gain > best[0] + 1e-9:
                        best = (gain, f, c)
            node.pop("number", None)
            if best[1] is not None:
                node.pop("leaf")
                left, right = ({"leaf": 0.0, "number": 2 * number + k} for k in (1, 2))
                node |= {"feature": best[1], "cut": float(best[2]), "left": left, "right": right}
                following |= {left["number"]: left, right["number"]: right}
        leaves = following
    return root
