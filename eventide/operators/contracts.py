"""Checks that tables keep their promises. Each is an aggregate, evaluated where the data is."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.functions.expr import finite, or_fail


def require_columns(df: DataFrame, columns: Sequence[str], what: str = "table") -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing columns: {', '.join(missing)}")
    return df


def prediction_contract(df: DataFrame, id_col: str = "id", pred: str = "pred") -> DataFrame:
    """One row: null ids, surplus ids, non-finite predictions, and whether all are zero."""
    require_columns(df, [id_col, pred], "predictions")
    return df.agg(
        F.count("*").alias("n"), F.count_if(F.col(id_col).isNull()).alias("null_ids"),
        (F.count(id_col) - F.count_distinct(id_col)).alias("duplicate_ids"),
        F.count_if(~finite(pred)).alias("non_finite"),
    ).withColumn("ok", (F.col("null_ids") == 0) & (F.col("duplicate_ids") == 0) & (F.col("non_finite") == 0))


def enforce_contract(df: DataFrame, id_col: str = "id", pred: str = "pred", what: str = "predictions") -> DataFrame:
    row = prediction_contract(df, id_col, pred).first()
    if not row["ok"]:
        raise ValueError(f"{what}: null ids {row['null_ids']}, duplicate ids {row['duplicate_ids']}, "
                         f"non-finite {row['non_finite']}")
    return df.select(id_col, F.col(pred).cast("double").alias(pred))


def id_difference(left: DataFrame, right: DataFrame, id_col: str = "id") -> DataFrame:
    """Ids found on one side only, labelled ``left`` or ``right``."""
    a, b = left.select(id_col), right.select(id_col)
    return (
        a.join(b, id_col, "left_anti").withColumn("only_in", F.lit("left"))
        .unionByName(b.join(a, id_col, "left_anti").withColumn("only_in", F.lit("right")))
    )


def id_equality(left: DataFrame, right: DataFrame, id_col: str = "id") -> DataFrame:
    """One row: sizes, ids missing on either side, surplus ids, and ``same``.

    Both sides are tallied per id in one union, so one shuffle answers every question.
    """
    per = (
        left.select(id_col, F.lit(1).alias("l"), F.lit(0).alias("r"))
        .unionByName(right.select(id_col, F.lit(0).alias("l"), F.lit(1).alias("r")))
        .groupBy(id_col).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    )
    return per.agg(
        F.coalesce(F.sum("l"), F.lit(0)).alias("left_rows"), F.coalesce(F.sum("r"), F.lit(0)).alias("right_rows"),
        F.count_if((F.col("l") > 0) & (F.col("r") == 0)).alias("missing_right"),
        F.count_if((F.col("r") > 0) & (F.col("l") == 0)).alias("missing_left"),
        F.count_if((F.col("l") > 1) | (F.col("r") > 1)).alias("repeated_ids"),
    ).withColumn("same", (F.col("missing_right") == 0) & (F.col("missing_left") == 0)
                 & (F.col("left_rows") == F.col("right_rows")))


def enforce_same_ids(left: DataFrame, right: DataFrame, id_col: str = "id", what: str = "id sets") -> None:
    row = id_equality(left, right, id_col).first()
    if not row["same"] or row["repeated_ids"]:
        raise ValueError(f"{what} differ: {row.asDict()}")


def join_same_ids(base: DataFrame, additions: DataFrame, id_col: str = "id", what: str = "ids") -> DataFrame:
    """Add columns by id; the job fails unless both sides hold exactly the same ids, each once.

    The check rides on the join: both sides are already brought together by id for it, so
    nothing is computed twice and no extra shuffle is needed.
    """
    values = [c for c in additions.columns if c != id_col]
    right = additions.groupBy(id_col).agg(*[F.any_value(c).alias(c) for c in values], F.count("*").alias("_right"))
    left = base.selectExpr("*", f"count(*) over (partition by {id_col}) as _left")
    checked = or_fail((F.col("_left") == 1) & (F.col("_right") == 1), f"{what} differ between the two tables")
    return left.join(right, id_col, "full").filter(checked).select(*base.columns, *values)


def contracted(df: DataFrame, preds: Sequence[str], id_col: str = "id", what: str = "predictions") -> DataFrame:
    """The same rows; the job that reads them fails at a null or repeated id or a prediction that is not finite."""
    require_columns(df, [id_col, *preds], what)
    ok = F.col(id_col).isNotNull()
    for p in preds:
        ok = ok & finite(p)
    sound = df.filter(or_fail(ok, f"{what}: null id or non-finite prediction"))
    return unique_rows(sound, [id_col], what)


def _counted(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumn("_copies", F.count(F.lit(1)).over(Window.partitionBy(*keys)))


def unique_rows(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """The same rows; the job that reads them fails if two share their keys.

    Rows are counted where they lie by key, which is how a join on these keys wants them, so the
    check costs neither a second computation of the table nor a shuffle of its own.
    """
    checked = or_fail(F.col("_copies") == 1, f"{what} is not unique on {', '.join(keys)}")
    return _counted(df, keys).filter(checked).drop("_copies")


def join_many_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join; the job fails if the right side is not unique on the keys.

    Right rows with a null key match nothing and are not judged; an empty left side asks nothing of the right one.
    """
    return left.join(unique_rows(right.dropna(subset=list(keys)), keys, "right side"), list(keys), "left")


def join_one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join; the job fails if either side is not unique on the keys."""
    return join_many_to_one(unique_rows(left, keys, "left side"), right, keys)


def join_complete(predictions: DataFrame, features: DataFrame, id_col: str = "id") -> DataFrame:
    """Inner join; the job fails unless every prediction row meets exactly one feature row."""
    joined = predictions.join(_counted(features, [id_col]), id_col, "left")
    return joined.filter(or_fail(F.col("_copies") == 1, "row mismatch between predictions and features")).drop("_copies")


def null_free_target(joined: DataFrame, target: str) -> DataFrame:
    """One row: rows and rows without a target after a left join."""
    return joined.agg(F.count("*").alias("n"), F.count_if(F.col(target).isNull()).alias("null_targets"))


def validate_output(output: DataFrame, template: DataFrame, id_col: str = "id", value: str = "duration_s",
                    max_value: float = 7200.0, expected_rows: int | None = None) -> DataFrame:
    """(check, level, violations) for an output that must match its template; fail-closed.

    Errors forbid the output, warnings only inform. Missing columns or a non-numeric value
    column are reported alone, since nothing else can be checked then.
    """
    spark = output.sparkSession
    schema = "check string, level string, violations long"
    absent = [c for c in (id_col, value) if c not in output.columns]
    if absent:
        return spark.createDataFrame([(f"column_{c}", "error", 1) for c in absent], schema)
    kind = dict(output.dtypes)[value]
    if kind not in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        return spark.createDataFrame([("numeric_value", "error", 1)], schema)
    v = F.col("v")
    per = (
        output.select(F.col(id_col).alias("i"), F.col(value).cast("double").alias("v"),
                      F.lit(1).alias("o"), F.lit(0).alias("t"))
        .unionByName(template.select(F.col(id_col).alias("i"), F.lit(0).alias("o"), F.lit(1).alias("t")),
                     allowMissingColumns=True)
        .groupBy("i").agg(
            F.sum("o").alias("o"), F.sum("t").alias("t"),
            F.sum(F.when((F.col("o") == 1) & v.isNull(), 1).otherwise(0)).alias("nulls"),
            F.count_if(F.isnan(v)).alias("nans"), F.count_if(F.abs(v) == float("inf")).alias("infs"),
            F.count_if(v < 0).alias("negatives"), F.count_if((v > max_value) & ~F.isnan(v)).alias("large"),
            F.min(v).alias("lo"), F.max(v).alias("hi"))
    )
    one = per.agg(
        F.abs(F.sum("o") - F.sum("t")).alias("row_count"),
        F.sum(F.greatest(F.col("o") - 1, F.lit(0))).alias("duplicate_ids"),
        F.count_if((F.col("t") > 0) & (F.col("o") == 0)).alias("missing_ids"),
        F.count_if((F.col("o") > 0) & (F.col("t") == 0)).alias("extra_ids"),
        F.sum("nulls").alias("null_values"), F.sum("nans").alias("nan_values"),
        F.sum("infs").alias("infinite_values"), F.sum("negatives").alias("negative_values"),
        F.sum("large").alias("large_values"),
        (((F.min("lo") == F.max("hi")) & (F.sum("nulls") == 0))
         | ((F.sum("nulls") == F.sum("o")) & (F.sum("o") > 0))).cast("long").alias("constant_values"),
        (F.abs(F.sum("t") - F.lit(expected_rows)) if expected_rows is not None
         else F.lit(0)).cast("long").alias("expected_rows"))
    errors = ["row_count", "duplicate_ids", "missing_ids", "extra_ids", "null_values", "nan_values",
              "infinite_values", "negative_values"]
    warnings = ["large_values", "constant_values", "expected_rows"]
    id_type = int(dict(output.dtypes)[id_col] != dict(template.dtypes)[id_col])
    rows = F.array(
        *[F.struct(F.lit(c).alias("check"), F.lit("error").alias("level"),
                   F.coalesce(F.col(c), F.lit(0)).cast("long").alias("violations")) for c in errors],
        *[F.struct(F.lit(c).alias("check"), F.lit("warning").alias("level"),
                   F.coalesce(F.col(c), F.lit(0)).cast("long").alias("violations")) for c in warnings],
        F.struct(F.lit("id_type").alias("check"), F.lit("warning").alias("level"),
                 F.lit(id_type).cast("long").alias("violations")))
    return one.select(F.inline(rows))


def output_name_ok(name: str) -> bool:
    """``<label>_v<integer>.parquet``."""
    stem, dot, suffix = name.rpartition(".")
    label, sep, version = stem.rpartition("_v")
    return bool(dot) and suffix == "parquet" and bool(sep) and version.isdigit()


def enforce_output(checks: DataFrame) -> None:
    bad = [(r["check"], r["violations"]) for r in checks.filter("level = 'error' and violations > 0").collect()]
    if bad:
        raise ValueError(f"output is not safe to publish: {bad}")
