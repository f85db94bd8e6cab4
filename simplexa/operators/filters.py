"""Row filters and projections."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from simplexa.functions import simplex as sx
from simplexa.operators.quantiles import quantiles
from simplexa.session import ship


def class_split(k: int, dummies: int = 6, protein: Sequence[int] | None = None) -> tuple[list[int], list[int]]:
    """Real and decoy class numbers: explicit, or all from ``dummies`` on; the rest are decoys."""
    real = sorted(protein) if protein is not None else list(range(dummies, k))
    return real, [i for i in range(k) if i not in real]


def load_posteriors(df: DataFrame, posterior: str = "posterior", uid: str = "uid") -> DataFrame:
    """uid, normalised posterior, hard class and largest component.

    The last two are kept as columns, since a predicate on an array cannot reach the scan.
    """
    p = sx.normalise(F.transform(F.col(f"`{posterior}`"), lambda x: x.cast("double")))
    base = df.select(F.col(f"`{uid}`").alias("uid"), p.alias("posterior"))
    return base.withColumns({"hard": sx.argmax(F.col("posterior")), "max_post": F.array_max("posterior")})


def renormalised_protein(df: DataFrame, k: int, dummies: int = 6) -> DataFrame:
    """Real-class posteriors of all rows, renormalised."""
    real, _ = class_split(k, dummies)
    return df.select("uid", sx.normalise_parts([F.get("posterior", F.lit(i)) for i in real]).alias("posterior"))


def protein_only(df: DataFrame, k: int, dummies: int = 6, protein: Sequence[int] | None = None) -> DataFrame:
    """Rows whose hard class is real; real components renormalised; class numbers closed up."""
    real, _ = class_split(k, dummies, protein)
    hard = sx.argmax(F.col("posterior"))
    kept = sx.computed(df.select("uid", "posterior"), h=hard).where(F.col("h").isin(real))
    place = (F.array_position(F.array(*[F.lit(i) for i in real]), F.col("h")) - 1).cast("int")
    own = sx.computed(kept.withColumnRenamed("posterior", "all"), hard=place, posterior=sx.normalise_parts([F.get("all", F.lit(i)) for i in real]))
    return own.select("uid", "hard", "posterior")


def above(df: DataFrame, threshold: float, vector: str = "posterior", inclusive: bool = False) -> DataFrame:
    """Rows whose largest component passes (P4; inclusive: P5)."""
    m = F.array_max(vector)
    return df.where(m >= threshold if inclusive else m > threshold)


def divergences(df: DataFrame, a: str = "p_a", b: str = "p_b") -> DataFrame:
    """Adds ``js``, the divergence of two vectors of one length, by the C library's logarithm.

    Rows that tie at a percentile are on its one side or the other by their last bits, and the JVM's logarithm differs in those
    from that of SQL engines in C.
    """
    ship(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField("js", T.DoubleType())])
    at = [df.columns.index(a), df.columns.index(b)]

    def components(v: pa.Array) -> list[np.ndarray]:
        x = np.maximum(v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1), sx.TINY)
        total = sum(x.T[1:], x[:, 0])
        return [c / total for c in x.T]

    def half(v: list[np.ndarray], mid: list[np.ndarray]) -> np.ndarray:
        terms = [x * np.fromiter(map(math.log, (x / m).tolist()), float, len(x)) for x, m in zip(v, mid, strict=True)]
        return sum(terms[1:], terms[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            js = pa.nulls(batch.num_rows, pa.float64())
            both = pc.and_(pc.is_valid(batch.column(at[0])), pc.is_valid(batch.column(at[1])))
            if pc.any(both).as_py():
                x, y = (components(batch.column(i).filter(both)) for i in at)
                mid = [(u + v) / 2 for u, v in zip(x, y, strict=True)]
                js = pc.replace_with_mask(js, both, pa.array((half(x, mid) + half(y, mid)) / 2))
            yield pa.RecordBatch.from_arrays([*batch.columns, js], [*batch.schema.names, "js"])

    return df.mapInArrow(run, schema)


def confidence_tiers(df: DataFrame, js: str = "js", agree: str = "agree") -> DataFrame:
    """full, hard, hcperm, hc: nested by agreement and by divergence below its 66th and 33rd percentile."""
    p66, p33 = (F.lit(x).cast("double") for x in quantiles(df, js, [0.66, 0.33]))
    ok = F.col(agree) == 1
    tier = F.when(ok & (F.col(js) < p33), "hc").when(ok & (F.col(js) < p66), "hcperm").when(ok, "hard").otherwise("full")
    return df.withColumn("tier", tier)


def pair_mass(df: DataFrame, i: int, j: int, k: int) -> DataFrame:
    """Rows with more than 1/k of their mass on two classes."""
    p = F.col("posterior")
    return df.where(F.get(p, F.lit(i)) + F.get(p, F.lit(j)) > 1.0 / k)


def weight_at_least(df: DataFrame, minimum: float, weight: str = "weight", hard: str = "hard", cls: str = "class") -> DataFrame:
    """Rows whose weight exceeds the minimum and whose hard class is the exported one."""
    return df.where((F.col(weight) > minimum) & (F.col(hard) == F.col(cls)))


def in_range(df: DataFrame, col: str, lo: float, hi: float) -> DataFrame:
    """[lo, hi) (P9)."""
    return df.where((F.col(col) >= lo) & (F.col(col) < hi))


def drop_constant(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Without those of ``columns`` whose standard deviation is 0 (P10)."""
    sd = df.agg(*[F.stddev_pop(c).alias(c) for c in columns]).first()
    return df.drop(*[c for c in columns if not sd[c]])


def pick_by_argmax(df: DataFrame, posterior: str, **fields: str) -> DataFrame:
    """For each new name the element of an array column at the largest posterior."""
    best = sx.argmax(F.col(f"`{posterior}`"))
    return df.withColumns({new: F.get(F.col(f"`{old}`"), best) for new, old in fields.items()})


def consensus_pose(df: DataFrame, prefix: str = "alignments3D_multi/") -> DataFrame:
    """One pose a row from per-class poses, with defaults for absent fields."""
    best = sx.argmax(F.col(f"`{prefix}class_posterior`"))
    has = set(df.columns)
    own = lambda name, default: F.col(f"`{prefix}{name}`") if f"{prefix}{name}" in has else default
    return df.select(
        "uid",
        own("split", F.lit(0)).cast("long").alias("alignments3D/split"),
        F.get(F.col(f"`{prefix}shift`"), best).alias("alignments3D/shift"),
        F.get(F.col(f"`{prefix}pose`"), best).alias("alignments3D/pose"),
        own("psize_A", F.lit(float("nan"))).cast("float").alias("alignments3D/psize_A"),
    )


def box(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows inside a box, ends included."""
    cond: Column = F.lit(True)
    for c, (lo, hi) in ranges.items():
        cond = cond & F.col(c).between(lo, hi)
    return df.where(cond)


def outliers(df: DataFrame, vector: str = "z", sds: float = 2.0) -> DataFrame:
    """Rows whose norm is at least mean + ``sds`` standard deviations."""
    n = df.withColumn("norm", sx.norm(F.col(vector)))
    stats = n.agg(F.avg("norm").alias("m"), F.stddev_pop("norm").alias("s"))
    return n.crossJoin(F.broadcast(stats)).where(F.col("norm") >= F.col("m") + sds * F.col("s")).drop("m", "s")  # one row


def clusters(df: DataFrame, ids: Sequence[int], label: str = "label") -> DataFrame:
    """Rows of some clusters."""
    return df.where(F.col(label).isin(list(ids)))


def junk_component(df: DataFrame, label: str = "label", vector: str = "z") -> DataFrame:
    """The component with the largest mean norm."""
    means = df.groupBy(label).agg(F.avg(sx.norm(F.col(vector))).alias("mean_norm"))
    return means.agg(F.max_by(label, F.struct("mean_norm", F.col(label))).alias("junk"))


def confidence_as_weight(df: DataFrame, vector: str = "resp", field: str = "alignments3D/alpha") -> DataFrame:
    """Largest responsibility written over a weight field, where there is one."""
    return df.withColumn(field, F.array_max(vector).cast(df.schema[field].dataType)) if field in df.columns else df
