"""Role detection: which column is date, revenue, category, region, price, quantity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustkpi import fixed
from trustkpi.functions.numbers import parse_number
from trustkpi.functions.text import text_array
from trustkpi.operators.clean import COPIES, POSITION
from trustkpi.operators.column_state import long_rows
from trustkpi.operators.keyed import Keys, attach, cols, data_columns
from trustkpi.operators.profile import profile
from trustkpi.session import stage

ROLES = ["date", "revenue", "category", "region", "price", "quantity"]


def name_bonus(name: Column, hints: list[str]) -> Column:
    """0.12 for every hint word in a clean header, at most 0.25."""
    words = F.split(name, " ")
    return F.least(F.lit(0.25), F.size(F.array_intersect(words, text_array(hints))) * F.lit(0.12))


def _capped(value: Column) -> Column:
    return F.round(F.least(F.lit(1.0), value), 4)


def role_score(role: str) -> Column:
    """Score of a profiled column for a role, 0 when it does not qualify."""
    bonus = name_bonus(F.col("column"), fixed.ROLE_HINTS[role])
    if role == "date":
        ratio = F.col("date_ratio")
        return F.when(ratio >= 0.6, _capped(ratio * 0.85 + bonus)).otherwise(0.0)
    if role in ("category", "region"):
        spread = F.col("distinct") / F.greatest("non_null", F.lit(1))
        fits = (F.col("distinct") >= 2) & (spread <= 0.6)
        return F.when(fits, _capped((1.0 - spread) * 0.75 + bonus)).otherwise(0.0)
    ratio = F.col("number_ratio")
    return F.when(ratio >= 0.7, _capped(ratio * 0.8 + bonus)).otherwise(0.0)


def role_scores(profiled: DataFrame, keys: Keys = ()) -> DataFrame:
    """Candidates in long form: (keys, role, column, pos, score), score above 0."""
    scored = F.array(*[F.struct(F.lit(r).alias("role"), role_score(r).alias("score")) for r in ROLES])
    return profiled.select(*cols(keys), "column", "pos", F.inline(scored)).where("score > 0")


def best(scores: DataFrame, keys: Keys = ()) -> DataFrame:
    """Highest score per role; the first column wins ties."""
    return scores.groupBy(*cols(keys), "role").agg(
        F.max_by("column", F.struct("score", -F.col("pos"))).alias("column"),
        F.max("score").alias("score"),
    )


def pick(df: DataFrame, name: Column, columns: list[str]) -> Column:
    """Value of the column whose name is given per row."""
    return F.coalesce(*[F.when(name == c, F.col(f"`{c}`")) for c in columns])


def consistency_bonus(cleaned: DataFrame, pair: DataFrame, keys: Keys = ()) -> DataFrame:
    """Bonus per column for agreeing with price times quantity: (keys, column, bonus).

    All columns are correlated in one aggregate.
    """
    columns = data_columns(cleaned, keys, POSITION, COPIES)
    rows = attach(cleaned, pair, keys)
    # The chosen texts first, so that the choice is made once and not in every step of the parse.
    rows = rows.select(
        *cols([*keys, *columns]), pick(rows, F.col("price_col"), columns).alias("_price"),
        pick(rows, F.col("quantity_col"), columns).alias("_quantity"),
    )
    # Every cell meets its row's product, so that one parse serves all columns.
    rows = rows.withColumn("_calc", parse_number("_price") * parse_number("_quantity")).where("_calc IS NOT NULL")
    pairs = long_rows(rows, [*keys, "_calc"], columns).select(
        *cols(keys), "column", parse_number("value").alias("_v"), "_calc"
    )
    calc = F.when(F.col("_v").isNotNull(), F.col("_calc"))
    wide = pairs.groupBy(*cols(keys), "column").agg(
        F.count("_v").alias("_n"), F.stddev_pop("_v").alias("_sv"), F.stddev_pop(calc).alias("_sc"),
        F.covar_pop("_v", "_calc").alias("_cv"),
    )
    varies = (F.col("_n") >= 3) & (F.col("_sv") > 0) & (F.col("_sc") > 0)
    # Spark's corr divides by zero for a constant column in ANSI mode.
    r = F.try_divide(F.col("_cv"), F.col("_sv") * F.col("_sc"))
    raw = F.greatest(F.lit(0.0), F.least(F.lit(0.2), r * 0.2))
    return wide.select(
        *cols(keys), "column", F.coalesce(F.when(varies & r.isNotNull(), F.round(raw, 4)), F.lit(0.0)).alias("bonus")
    )


def scored_candidates(cleaned: DataFrame, keys: Keys = (), order: DataFrame | None = None) -> DataFrame:
    """All role scores with the consistency bonus added to revenue."""
    scores = stage(role_scores(profile(cleaned, keys, order), keys), "scores")
    pair = best(scores.where(F.col("role").isin("price", "quantity")), keys)
    pair = stage(
        pair.groupBy(*cols(keys)).agg(
            F.max(F.when(F.col("role") == "price", F.col("column"))).alias("price_col"),
            F.max(F.when(F.col("role") == "quantity", F.col("column"))).alias("quantity_col"),
        ),
        "pair",
    )
    bonus = consistency_bonus(cleaned, pair, keys)
    lifted = attach(scores.where("role = 'revenue'"), bonus, [*keys, "column"])
    lifted = lifted.withColumn(
        "score", F.least(F.lit(1.0), F.col("score") + F.coalesce("bonus", F.lit(0.0)))
    ).drop("bonus")
    return scores.where("role <> 'revenue'").unionByName(lifted)


def detect_schema(cleaned: DataFrame, keys: Keys = (), order: DataFrame | None = None) -> DataFrame:
    """One row per key: role columns, role confidences, overall confidence.

    ``order`` (keys, column, pos) gives the columns' places where they differ between datasets.
    """
    scores = stage(scored_candidates(cleaned, keys, order), "roles")
    chosen = best(scores.where("role <> 'region'"), keys)
    category = chosen.where("role = 'category'").select(*cols(keys), F.col("column").alias("_cat"))
    if not keys:
        category = category.agg(F.max("_cat").alias("_cat"))
    region = attach(scores.where("role = 'region'"), category, keys).where(~F.col("column").eqNullSafe(F.col("_cat")))
    chosen = chosen.unionByName(best(region.drop("_cat"), keys))

    def of(role: str, what: str) -> Column:
        return F.max(F.when(F.col("role") == role, F.col(what)))

    wide = chosen.groupBy(*cols(keys)).agg(
        *[of(r, "column").alias(f"{r}_col") for r in ROLES],
        *[F.coalesce(of(r, "score"), F.lit(0.0)).alias(f"_{r}") for r in ROLES],
    )
    confidence = F.round(
        F.col("_date") * 0.4 + F.col("_revenue") * 0.4 + F.col("_category") * 0.1 + F.col("_region") * 0.1, 4
    )
    by_role = F.create_map(
        *[part for r in ("date", "revenue", "category", "region") for part in (F.lit(r), F.col(f"_{r}"))]
    )
    return wide.select(
        *cols(keys), *[f"{r}_col" for r in ROLES], confidence.alias("confidence"),
        by_role.alias("column_confidence"),
    )


def schema_payload(schema: DataFrame, cleaned: DataFrame, keys: Keys = ()) -> DataFrame:
    """Roles, confidences, row count and canonical column list, one row per key.

    The list has the columns that hold any value, in table order, then the
    detected roles that are not among them.
    """
    columns = data_columns(cleaned, keys, POSITION, COPIES)
    seen = cleaned.groupBy(*cols(keys)).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.array_compact(F.array(*[F.when(F.count(c) > 0, n) for n, c in zip(columns, cols(columns))])).alias("_own"),
    )
    wide = attach(schema, seen, keys)
    found = F.array_compact(F.array(*[F.when(F.col(f"{r}_col").isNotNull(), r) for r in ROLES]))
    return wide.select(
        *cols(keys), "date_col", "revenue_col", "category_col", "region_col", "confidence", "column_confidence",
        "row_count", F.array_union("_own", found).alias("columns"),
    )
