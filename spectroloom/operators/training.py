"""Tables that scorers are trained from: ion frequencies, ranks, mass errors, offsets, score tables and graphs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spectroloom.functions import arrays, numeric
from spectroloom.functions.mass import RESIDUE_MASS


def read_score_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A tab-separated matrix without header, one line a mass bin: (name, mass_bin, bin, score), bins from 0.

    Lines are numbered in the order of one file, which is small (tens of lines).
    """
    lines = spark.read.text(path).coalesce(1).where(F.trim("value") != "").withColumn("_n", F.monotonically_increasing_id())
    numbered = lines.select((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_n")) - 1).alias("mass_bin"), "value")
    rows = numbered.select("mass_bin", F.posexplode(F.split(F.trim("value"), "\t")).alias("bin", "text"))
    return rows.select(F.lit(name).alias("name"), "mass_bin", "bin", F.col("text").try_cast("double").alias("score"))


def write_score_table(table: DataFrame, path: str) -> None:
    """The matrix back as lines in order of mass bin."""
    lines = table.groupBy("mass_bin").agg(F.array_sort(F.collect_list(F.struct("bin", "score"))).alias("r"))
    text = F.array_join(F.transform("r", lambda x: x["score"].cast("string")), "\t")
    lines.coalesce(1).sortWithinPartitions("mass_bin").select(text.alias("value")).write.text(path)


def mass_error_table(matched: DataFrame, keys: Sequence[str], cut: str, mass: str, expected: str, width: float, bins: int) -> DataFrame:
    """Histogram of the error of the mass gap between neighbouring matched fragments: (bin, n), bins of width ``width`` about 0."""
    w = Window.partitionBy(*keys).orderBy(cut)
    gap = (F.lead(mass).over(w) - F.col(mass)) - (F.lead(expected).over(w) - F.col(expected))
    pairs = matched.withColumn("_next", F.lead(cut).over(w)).withColumn("_e", gap).where(F.col("_next") == F.col(cut) + 1)
    half = width * bins / 2
    return pairs.groupBy(F.expr(f"width_bucket(_e, {-half!r}D, {half!r}D, {bins})").alias("bin")).agg(F.count("*").alias("n"))


def probabilities(counts: DataFrame, keys: Sequence[str], n: str = "n", name: str = "probability") -> DataFrame:
    """Counts over their total within ``keys``."""
    return counts.withColumn(name, F.col(n) / F.sum(n).over(Window.partitionBy(*keys)))


def log_ratio(target: DataFrame, decoy: DataFrame, keys: Sequence[str], floor: float = 1e-10) -> DataFrame:
    """keys with target and decoy probability and the log of their ratio, 0 if either is tiny or absent."""
    both = target.select(*keys, F.col("probability").alias("target")).join(decoy.select(*keys, F.col("probability").alias("decoy")), list(keys), "full").fillna({"target": 0.0, "decoy": 0.0})
    return both.withColumn("score", F.when((F.col("target") < floor) | (F.col("decoy") < floor), F.lit(0.0)).otherwise(F.log(F.col("target") / F.col("decoy"))))


def ion_scores(observed: DataFrame, envelope: str = "envelope", seen: str = "observed") -> DataFrame:
    """``observed`` with ``corr``, ``dist`` and ``cosine`` of its envelope arrays."""
    a, b = F.col(envelope), F.col(seen)
    return observed.withColumn("corr", arrays.pearson(a, b)).withColumn("dist", arrays.bhattacharyya(a, b)).withColumn("cosine", arrays.cosine(a, b))


def linear_score(df: DataFrame, weights: dict[str, float], offset: float = 0.0) -> DataFrame:
    """``df`` with ``raw_score`` (a weighted sum of columns) and ``probability`` (its logistic value)."""
    raw = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w for c, w in weights.items()), F.lit(offset))
    return df.withColumn("raw_score", raw).withColumn("probability", F.lit(1.0) / (1 + F.exp(-F.col("raw_score"))))


def significance_score(peaks: DataFrame, keys: Sequence[str], intensity: str, matched: str) -> DataFrame:
    """keys with -log2 of the rank-sum p-value that matched peaks are as intense as they are by chance, and of the
    hypergeometric p-value that so many of the upper half are matched."""
    w = Window.partitionBy(*keys)
    ranked = peaks.withColumn("_r", F.row_number().over(w.orderBy(F.col(intensity).desc()))).withColumn("_n", F.count("*").over(w))
    hit = F.col(matched).cast("int")
    upper = (F.col("_r") <= F.col("_n") / 2).cast("int")
    agg = ranked.groupBy(*keys).agg(F.max("_n").alias("n"), F.sum(hit).alias("n1"), F.sum(hit * F.col("_r")).alias("r1"), F.sum(upper).alias("_k"), F.sum(hit * upper).alias("_k1"))
    p = agg.withColumn("rank_p", numeric.rank_sum_udf(F.col("n").cast("double"), F.col("n1").cast("double"), F.col("r1").cast("double"))).withColumn("hyper_p", numeric.hypergeometric_udf("n", "_k", "n1", F.greatest(F.lit(0), F.col("_k1") - 1)))
    return p.select(*keys, "n", "n1", (-F.log2(F.greatest(F.lit(1e-300), "rank_p"))).alias("rank_score"), (-F.log2(F.greatest(F.lit(1e-300), "hyper_p"))).alias("hyper_score"))


def scoring_graph(most: int, residues: dict[str, float] = RESIDUE_MASS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges between reachable nominal masses up to ``most`` in compressed rows: (row starts, ends, residue numbers).

    Edge e of node m for starts[m] <= e < starts[m + 1] leads to ends[e]; nodes that no sequence
    reaches have none.
    """
    from spectroloom.operators.evidence import reachable_bins

    steps = [int(round(m * 0.9995)) for m in residues.values()]
    reached = np.zeros(most + 1, bool)
    reached[reachable_bins(most, tuple(residues.values()))] = True
    starts, ends, names = [0], [], []
    for m in range(most + 1):
        if reached[m]:
            for k, s in enumerate(steps):
                if m + s <= most:
                    ends.append(m + s)
                    names.append(k)
        starts.append(len(ends))
    return np.array(starts), np.array(ends), np.array(names)


def feature_map(features: DataFrame, mass: str, time: str, abundance: str, mass_width: float, time_width: float) -> DataFrame:
    """(mass_bin, time_bin, log_abundance): the cells of a heat map."""
    cells = features.groupBy(F.floor(F.col(mass) / mass_width).alias("mass_bin"), F.floor(F.col(time) / time_width).alias("time_bin")).agg(F.sum(abundance).alias("_a"))
    return cells.where(F.col("_a") > 0).select("mass_bin", "time_bin", F.log10("_a").alias("log_abundance"))


def smoothed_area(points: DataFrame, keys: Sequence[str], at: str, intensity: str) -> DataFrame:
    """keys with the area under the nine-point smoothed chromatogram between where it falls below 1 % of its apex."""
    schema = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in keys) + ", area double, apex double, start double, stop double"

    def within(group: pd.DataFrame) -> pd.DataFrame:
        from spectroloom.operators.windows import SMOOTHING

        group = group.sort_values(at)
        x, y = group[at].to_numpy(float), group[intensity].to_numpy(float)
        smooth = np.maximum(np.convolve(np.pad(y, 4), np.array(SMOOTHING) / 231, "valid"), 0)
        top = int(smooth.argmax())
        low = smooth < smooth[top] * 0.01
        a = int(np.flatnonzero(low[:top])[-1]) + 1 if low[:top].any() else 0
        b = top + int(np.flatnonzero(low[top:])[0]) if low[top:].any() else len(x)
        return pd.DataFrame([[*(group[k].iloc[0] for k in keys), float(np.trapezoid(smooth[a:b], x[a:b])), x[top], x[a], x[b - 1]]], columns=[*keys, "area", "apex", "start", "stop"])

    return points.groupBy(*keys).applyInPandas(within, schema)

