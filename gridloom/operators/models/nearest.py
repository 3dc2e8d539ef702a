"""k-nearest-neighbour prediction on the exact neighbour join."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gridloom.operators.models.base import Fitted, Training, scorer
from gridloom.operators.neighbours import build_index, distinct_points, nearest
from gridloom.operators.ordering import with_positions

NEIGHBOURS = 5


def knn(t: Training) -> Fitted:
    """Keep the distinct training positions with their label totals."""
    if t.classes:
        totals = [
            F.count(F.when(F.col("label") == c, 1)).cast("double") for c in range(t.classes)
        ]
    else:
        totals = [F.sum("label")]
    points = distinct_points(t.df.select("x", "label"), *totals)
    return Fitted("neighbours", {"classes": t.classes, "k": min(NEIGHBOURS, t.rows)}, table=points)


def lookup(fitted: Fitted, df, k: int):
    """Rows of ``df`` with the neighbours of their position in ``near``.

    Equal positions are looked up once and joined back on the position.
    """
    queries = with_positions(df.select("x").distinct(), ["x"]).withColumnRenamed("position", "qid")
    found = nearest(build_index(fitted.table), queries, k)
    return df.join(queries.join(found, "qid").select("x", "near"), "x")


@scorer("neighbours")
def _neighbours(fitted, df):
    """Votes weighted by inverse distance; exact matches alone decide."""
    k, classes = int(fitted.params["k"]), int(fitted.params["classes"])

    @F.pandas_udf("double")
    def decide(near: pd.Series) -> pd.Series:
        out = []
        for entries in near:
            left, share, total = k, 0.0, 0.0
            exact = any(e["distance"] == 0 for e in entries)
            for e in entries:
                # Copies of one position share their votes evenly.
                taken = min(left, e["w"])
                left -= taken
                if exact and e["distance"] > 0 or taken <= 0:
                    continue
                weight = taken * (1.0 if exact else 1.0 / e["distance"])
                share = share + weight * np.asarray(e["payload"], float) / e["w"]
                total += weight
            out.append(float(np.argmax(share)) if classes else float(share[0] / total))
        return pd.Series(out, dtype=float)

    return lookup(fitted, df, k).withColumn("prediction", decide("near")).drop("near")
