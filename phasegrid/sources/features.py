"""From tables to observations: dictionaries, numeric representations, signatures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasegrid.operators import display


#: Most levels of a model's categorical columns.
MAX_LEVELS = 10_000


def dictionary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``level, code`` of the pooled, sorted levels of all categorical columns, codes from 1, and where each occurs.

    ``present`` is an array of booleans by column. Levels are few; rows are pre-aggregated before they meet.
    """
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("col"), F.col(c).cast("string").alias("level")) for i, c in enumerate(columns)]))
    pooled = df.select(each.alias("e")).select("e.*").where("level IS NOT NULL").groupBy("level").agg(F.collect_set("col").alias("cols"))
    code = F.row_number().over(Window.orderBy("level"))
    present = F.array(*[F.array_contains("cols", i) for i in range(len(columns))])
    return pooled.select("level", code.alias("code"), present.alias("present"))


def encoded(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Adds ``<column>_code`` from 0 for each categorical column, and the pooled levels in order of code.

    Level probabilities are parameters of the model, so their number is bounded: more than ``MAX_LEVELS`` raise. Codes are
    a constant map in the projection: no join.
    """
    found = dictionary(df, columns)
    n = found.count()
    if n > MAX_LEVELS:
        raise ValueError(f"{n} levels; a model holds at most {MAX_LEVELS}")
    levels = [r["level"] for r in found.orderBy("code").collect()]
    if not levels:
        return df, levels
    codes = F.create_map(*[F.lit(v) for k, x in enumerate(levels) for v in (x, k)])
    return df.withColumns({f"{c}_code": codes[F.col(c).cast("string")] for c in columns}), levels


def numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns cast to double; raises if a value that isn't null doesn't convert."""
    cast = {c: F.col(c).cast("int").cast("double") if t == "boolean" else F.expr(f"try_cast(`{c}` AS double)") for c, t in df.dtypes if c in columns}
    bad = df.agg(*[F.count_if(F.col(c).isNotNull() & v.isNull()).alias(c) for c, v in cast.items()]).first()
    wrong = [c for c in cast if bad[c]]
    if wrong:
        raise ValueError(f"not numeric: {', '.join(wrong)}")
    return df.withColumns(cast)


def ranks(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """An ordered category as its rank from 1."""
    return df.withColumn(column, F.create_map(*[F.lit(v) for k, x in enumerate(order) for v in (x, float(k + 1))])[F.col(column)])


def standardised(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns minus their mean over their sample standard deviation (1 where that is 0)."""
    row = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    return df.withColumns({c: (F.col(c) - F.lit(row[f"m_{c}"])) / F.lit(row[f"s_{c}"] or 1.0) for c in columns})


def represented(df: DataFrame, columns: Sequence[str], kind: str = "raw") -> tuple[DataFrame, list[str]]:
    """``raw``, ``normalized``, ``PCk`` (scaled) or ``rawPCk`` / ``PCk_raw`` (centred only), and the names to use."""
    df = numeric(df, columns)
    if kind == "raw":
        return df, list(columns)
    if kind == "normalized":
        return standardised(df, columns), list(columns)
    plain = kind.startswith("raw") or kind.endswith("_raw")
    core = kind.removeprefix("raw").removesuffix("_raw")
    if not core.startswith("PC") or not core[2:].isdigit():
        raise ValueError(f"unknown representation {kind}")
    k = min(int(core[2:]), len(columns))
    return display.principal_scores(df, columns, k, not plain), [f"pc{i + 1}" for i in range(k)]


def complete(df: DataFrame, columns: Sequence[str] | None = None, drop: Sequence[str] = ()) -> DataFrame:
    """Rows without nulls, without the columns named."""
    return df.drop(*drop).na.drop(subset=list(columns) if columns else None)


def signature(df: DataFrame) -> str:
    """A digest of schema and rows that doesn't depend on their order; one aggregate."""
    import hashlib

    row = df.select(F.xxhash64(*[F.col(c) for c in df.columns]).alias("h")).agg(
        F.count("*").alias("n"), F.expr("bit_xor(h)").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s")
    ).first()
    return hashlib.sha256(f"{df.schema.json()}|{row['n']}|{row['x']}|{row['s']}".encode()).hexdigest()


def bind_rows(tables: Sequence[DataFrame]) -> DataFrame | None:
    """Tables with different columns, one after the other; missing columns are null. None if there are no tables."""
    out = None
    for t in tables:
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def safe_column(df: DataFrame, name: str, default: object = None) -> Column:
    """A column, or a constant where the table has none of that name."""
    return F.col(f"`{name}`") if name in df.columns else F.lit(default)
