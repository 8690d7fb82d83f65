"""An outside comparison: normal mixtures by Spark ML, their number of components chosen by ICL."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasegrid.sources import features


def icl_path(df: DataFrame, columns: list[str], components: list[int], seed: int = 1, scale: bool = True, loops: int = 50) -> tuple[DataFrame, DataFrame]:
    """(``g, log_likelihood, bic, icl`` by number of components, the rows with ``cluster`` of the best by ICL, from 1).

    BIC is 2 log L minus parameters times ln n; ICL takes off twice the entropy of the assignment as well. Larger is better.
    """
    shown = features.standardised(df, columns) if scale else df
    rows = VectorAssembler(inputCols=columns, outputCol="_v").transform(shown).persist()
    n, p = rows.count(), len(columns)
    found, best = [], None
    for g in components:
        if g == 1:  # one normal distribution, in closed form
            row = rows.agg(*[F.covar_pop(F.col(a), F.col(b)) for a in columns for b in columns]).first()
            _, log_det = np.linalg.slogdet(np.array(row, float).reshape(p, p))
            like = -n / 2 * (p * math.log(2 * math.pi) + log_det + p)
            bic = float(2 * like - (p + p * (p + 1) // 2) * math.log(n))
            found.append((1, float(like), bic, bic))
            if best is None or bic > best[0]:
                best = (bic, rows.withColumn("cluster", F.lit(0)))
            continue
        model = GaussianMixture(k=g, featuresCol="_v", probabilityCol="_p", predictionCol="cluster", seed=seed, maxIter=loops).fit(rows)
        out = model.transform(rows)
        entropy = F.aggregate(vector_to_array("_p"), F.lit(0.0), lambda a, v: a - F.when(v > 0, v * F.ln(v)).otherwise(0.0))
        e = out.agg(F.sum(entropy)).first()[0]
        free = g - 1 + g * p + g * p * (p + 1) // 2
        bic = 2 * model.summary.logLikelihood - free * math.log(n)
        found.append((g, float(model.summary.logLikelihood), float(bic), float(bic - 2 * e)))
        if best is None or found[-1][3] > best[0]:
            best = (found[-1][3], out)
    table = df.sparkSession.createDataFrame(found, "g int, log_likelihood double, bic double, icl double")
    return table, best[1].withColumn("cluster", F.col("cluster") + 1).select(*df.columns, "cluster")
