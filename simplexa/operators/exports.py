"""Exports of row subsets with manifests, and rule-based verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simplexa.functions import simplex as sx
from simplexa.session import Written
from simplexa.sources import formats


#: rows of a file where the number of files is not given
FILE_ROWS = 500_000


def subset(selection: DataFrame, table: DataFrame, path: str, by: str = "class", key: str = "uid", twin: DataFrame | None = None, files: int | None = None) -> DataFrame:
    """Selected rows of a table as ``.cs`` files, ``path``/<class>/main, one folder a class (K1, K2, G10); returns rows by class.

    With ``twin`` the passthrough fields of the same rows go to ``path``/<class>/passthrough, in the same
    files and order; a row must be in both tables.  Rows are ordered by key
    within a file.  A class has ``files`` files, dealt by key; without it one for every ``FILE_ROWS`` rows.
    """
    rows = table.join(selection.select(key, F.col(by).alias("_by")), key)
    if twin is not None:
        rows = rows.join(twin.select(key, F.struct(*[F.col(f"`{c}`") for c in twin.columns]).alias("_twin")), key)
    own = [F.col(f"`{c}`") for c in table.columns]
    written = Written(table.sparkSession, "subset")
    held = written(rows)  # both tables are cut from the same rows
    counts = held.groupBy(F.col("_by").alias(by)).agg(F.count("*").alias("n")).orderBy(by).collect()
    for name, n in counts:
        mine = held.where(F.col("_by").eqNullSafe(F.lit(name))).repartition(files or -(-n // FILE_ROWS), key).sortWithinPartitions(key)
        formats.write_cs(mine.select(*own), f"{path}/{name}/main")
        if twin is not None:
            formats.write_cs(mine.select("_twin.*"), f"{path}/{name}/passthrough")
    out = table.sparkSession.createDataFrame([tuple(r) for r in counts], f"{by} {selection.schema[by].dataType.simpleString()}, n long")
    written.drop()
    return out


def overwrite_weight(df: DataFrame, weight: str, field: str = "alignments3D/alpha", mode: str = "replace") -> DataFrame:
    """Weights written over a field, or multiplied into it, in the field's type."""
    if mode == "none":
        return df
    old = F.col(f"`{field}`")
    new = F.col(weight) if mode == "replace" else old * F.col(weight)
    return df.withColumn(field, new.cast(df.schema[field].dataType))


def append_posterior(df: DataFrame, posteriors: DataFrame, k: int, name: str = "latent/class_posterior", key: str = "uid") -> DataFrame:
    """A posterior field, uniform where there is none (K4)."""
    p = posteriors.select(key, F.col("posterior").alias("_p"))
    return df.join(p, key, "left").withColumn(name, F.coalesce("_p", F.array_repeat(F.lit(1.0 / k), k))).drop("_p")


def manifest(df: DataFrame, by: list[str], weight: str = "weight") -> DataFrame:
    """Rows, effective number and mean weight of each export."""
    w = F.col(weight)
    return df.groupBy(*by).agg(F.count("*").alias("n_particles"), F.sum(w).alias("effective_n"), F.avg(w).alias("mean_weight"))


def particle_list(df: DataFrame, label: str, score: Column, key: str = "uid") -> DataFrame:
    """Unsigned id, class label and score of each row."""
    return df.select(sx.unsigned(F.col(key)).cast("string").alias("uid"), sx.class_label(F.col(label)).alias("class"), F.format_number(score, 6).alias("score"))


def matrix(cells: DataFrame, k: int) -> DataFrame:
    """i, j, value as one row a class (K5)."""
    return cells.groupBy("i").pivot("j", list(range(k))).agg(F.first("value")).orderBy("i")


def write_csv(df: DataFrame, path: str) -> None:
    """A class-sized summary as one file (K5)."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON object a row, without private columns (K6)."""
    return df.select(F.to_json(F.struct(*[c for c in df.columns if not c.startswith("_")])).alias("value"))


def points(df: DataFrame, vector: str, d: int, label: str | None = None) -> DataFrame:
    """``%.6f`` rows for a decoder, with the label alongside (K9)."""
    text = F.concat_ws(" ", *[F.format_string("%.6f", F.get(vector, F.lit(i))) for i in range(d)])
    return df.select(text.alias("value"), *([label] if label else []))


#: name -> (metric, predicate): the flags of a report.
RULES: dict[str, tuple[str, str]] = {
    "unstable": ("last_corr", "< 0.95"),
    "not_converged": ("relative_range", "> 0.01"),
    "confounded": ("max_abs_corr", "> 0.3"),
    "overconfident": ("gap", "> 0.15"),
}


def verdicts(metrics: DataFrame, rules: dict[str, tuple[str, str]] = RULES) -> DataFrame:
    """Rules on a one-row table of metrics as boolean columns."""
    return metrics.select("*", *[F.expr(f"coalesce(`{m}` {p}, false)").alias(n) for n, (m, p) in rules.items() if m in metrics.columns])
