"""Which column plays which role. Names and types only, so no job, unless a count is asked for."""

from pyspark.sql import functions as F

from ebbtide.functions import fixed
from ebbtide.functions.columns import category_columns, col, missing, numeric_columns, value
from ebbtide.functions.names import (
    contains_words, find_column, match_column, match_columns, name_words, plain)
from ebbtide.session import materialize


def detect_columns(columns):
    """{role: column or None} for the roles of a customer table, exact names only."""
    return {r: find_column(columns, names) for r, names in fixed.ROLE_ALIASES.items()}


def dataset_roles(columns):
    """{role: column or None} of the universal profile, by exact name or containment."""
    return {r: match_column(columns, names) for r, names in fixed.PROFILE_ALIASES.items()}


def input_columns(columns):
    """Columns that came with the data, without those scoring writes."""
    made = {plain(c) for c in fixed.PRODUCED_COLUMNS}
    return [c for c in columns if plain(c) not in made]


def two_valued(df, name):
    """Whether the column holds exactly two different values, the rows without one aside."""
    v = value(df, name)
    low, high = df.agg(F.min(v), F.max(v)).first()
    if low is None or low == high:
        return False
    return df.where((v != F.lit(low)) & (v != F.lit(high))).isEmpty()


def detect_target(columns, df=None):
    """Label column by exact alias, then by an alias or keyword among the words of its name. A
    column that exactly names another role is no label, and with the data at hand a column
    found by part of its name only counts if it holds two values."""
    exact = find_column(columns, fixed.SIGNAL_ALIASES["target"])
    if exact is not None:
        return exact
    other = {plain(a) for family, aliases in fixed.SIGNAL_ALIASES.items() if family != "target" for a in aliases}
    free = [c for c in input_columns(columns) if plain(c) not in other]
    found = [c for c in free if contains_words(c, fixed.SIGNAL_ALIASES["target"])]
    found += [c for c in free if c not in found
              and any(w.startswith(k) for w in name_words(c) for k in fixed.TARGET_KEYWORDS)]
    return next((c for c in found if df is None or two_valued(df, c)), None)


def detect_customer_id(columns):
    return match_column(columns, fixed.SIGNAL_ALIASES["customer_id"])


def signal_columns(columns, skip=()):
    """{family: columns}; a column serves one family, the first that claims it."""
    free = [c for c in columns if c not in skip]
    out = {}
    for family in ("recency", "usage", "tenure", "support", "payment", "spend"):
        aliases = fixed.SIGNAL_ALIASES[family]
        if family == "tenure":
            out[family] = [h for h in [match_column(free, aliases)] if h]
        else:
            out[family] = match_columns(free, aliases)
        free = [c for c in free if c not in out[family]]
    return out


def has_features(columns, features):
    """A model fits a table that holds all its training features."""
    return bool(features) and set(features) <= set(columns)


def scoring_mode(columns, df=None):
    return fixed.MODE_ADAPTIVE if detect_target(columns, df) else fixed.MODE_BEHAVIOR


def _text_or_null(x):
    return F.lit(x).cast("string")


def profile_dataset(df):
    """One row: shape, role columns and type counts."""
    roles = dataset_roles(df.columns)
    return df.agg(
        F.count("*").alias("rows"), F.lit(len(df.columns)).cast("long").alias("columns"),
        *[_text_or_null(c).alias(f"{r}_column") for r, c in roles.items()],
        F.lit(len(numeric_columns(df))).cast("long").alias("numeric_columns"),
        F.lit(len(category_columns(df))).cast("long").alias("categorical_columns"),
        F.lit(bool(roles["churn"])).alias("actual_churn_available"))


def analyze_dataset(df):
    """One row: shape, target, id, types, missing cells, duplicates and planned scoring mode, as
    scoring will see the table (null tokens gone, numbers typed, copies of a row once). Rows are
    grouped once; typing and counting then read the written groups."""
    from ebbtide.operators.clean import scoring_clean
    whole = df.select(*[value(df, c).alias(c) for c in df.columns])
    whole = materialize(whole.groupBy(*[col(c) for c in df.columns]).agg(F.count("*").alias("__n")), "rows")
    copies = whole.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).cast("long")).scalar()
    cleaned = scoring_clean(whole.drop("__n"))
    target, numbers = detect_target(cleaned.columns, cleaned), numeric_columns(cleaned)
    gaps = sum((missing(cleaned, c).cast("long") for c in cleaned.columns), F.lit(0).cast("long"))
    return cleaned.agg(
        F.count("*").alias("rows"), F.lit(len(cleaned.columns)).cast("long").alias("columns"),
        _text_or_null(target).alias("target_column"),
        _text_or_null(detect_customer_id(cleaned.columns)).alias("customer_id_column"),
        F.lit(len(numbers)).cast("long").alias("numeric_columns"),
        F.lit(len(cleaned.columns) - len(numbers)).cast("long").alias("categorical_columns"),
        F.coalesce(F.sum(gaps), F.lit(0)).cast("long").alias("missing_values"),
        F.lit(fixed.MODE_ADAPTIVE if target else fixed.MODE_BEHAVIOR).alias("prediction_mode")
    ).withColumn("duplicate_rows", copies)
