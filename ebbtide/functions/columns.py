"""Column expressions shared by all operators. Everything here stays in the JVM."""

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.functions import fixed

TEXT = (T.StringType, T.CharType, T.VarcharType)
FLOATING = (T.FloatType, T.DoubleType)


def col(name):
    return F.col("`" + name.replace("`", "``") + "`")


def dtype(df, name):
    return df.schema[name].dataType


def is_text(df, name):
    return isinstance(dtype(df, name), TEXT)


def is_number(df, name):
    return isinstance(dtype(df, name), T.NumericType)


def numeric_columns(df):
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def category_columns(df):
    return [f.name for f in df.schema.fields if isinstance(f.dataType, TEXT + (T.BooleanType,))]


def finite(c):
    """Neither NaN nor an infinity; NULL for NULL."""
    return ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def value(df, name):
    """The column with NaN and infinities turned into NULL, the only missing marker used here."""
    if isinstance(dtype(df, name), FLOATING):
        return F.when(finite(col(name)), col(name))
    return col(name)


def missing(df, name):
    if isinstance(dtype(df, name), FLOATING):
        return col(name).isNull() | ~finite(col(name))
    return col(name).isNull()


def parse_number(text, currency=False):
    """Guarded cast: try_cast alone would read "12d" as 12."""
    t = F.trim(text)
    if currency:
        t = F.trim(F.regexp_replace(t, fixed.CURRENCY_PATTERN, ""))
    return F.when(t.rlike(fixed.NUMBER_PATTERN), t.try_cast("double"))


def number(df, name, currency=False):
    """The column as double; text that is not a number becomes NULL. No column, no value."""
    if name is None:
        return F.lit(None).cast("double")
    if is_text(df, name):
        return parse_number(col(name), currency)
    if isinstance(dtype(df, name), T.BooleanType):
        return col(name).cast("int").cast("double")
    if isinstance(dtype(df, name), T.NumericType):
        return value(df, name).cast("double")
    return F.lit(None).cast("double")


def number_or_zero(df, name):
    return F.coalesce(number(df, name), F.lit(0.0))


def clip(x, low, high):
    """Clamp that keeps NULL, which greatest/least would drop."""
    return F.when(x < low, F.lit(float(low))).when(x > high, F.lit(float(high))).otherwise(x)


def text(name):
    return F.trim(col(name).cast("string"))


def lower_text(name):
    return F.lower(text(name))


def category(name):
    return F.coalesce(text(name), F.lit("Unknown"))


def drop_null_tokens(c):
    """Trimmed text with the usual missing-value spellings turned into NULL."""
    t = F.trim(c)
    return F.when(~t.isin(fixed.NULL_TOKENS), t)


def label(df, name, positive=fixed.CHURN_WORDS, negative=fixed.RETAIN_WORDS):
    """Churn label as 1, 0 or NULL. Numbers are read by value, text by word."""
    if is_number(df, name):
        v = value(df, name)
        return F.when(v == 1, 1).when(v == 0, 0)
    t = lower_text(name)
    return F.when(t.isin(positive), 1).when(t.isin(negative), 0)


def status(name):
    """Churn / Retained / Unknown from a label or prediction column."""
    if name is None:
        return F.lit("Unknown")
    t = lower_text(name)
    return (F.when(t.isin(fixed.STATUS_CHURN), "Churn")
            .when(t.isin(fixed.STATUS_RETAINED), "Retained").otherwise("Unknown"))


def churn_mask(name):
    if name is None:
        return F.lit(False)
    return F.coalesce(lower_text(name).isin(fixed.STATUS_CHURN + fixed.MASK_EXTRA), F.lit(False))


def prediction_label(df, name):
    """Churn / Retained from a model output given as number or word."""
    if is_text(df, name):
        hit = lower_text(name).isin(fixed.PREDICTED_CHURN_WORDS)
    else:
        hit = number(df, name) >= 0.5
    return F.when(hit, "Churn").otherwise("Retained")


def risk_level_of_probability(p):
    return (F.when(p >= 0.75, "Critical").when(p >= 0.50, "High")
            .when(p >= 0.25, "Medium").when(p.isNotNull(), "Low"))


def risk_score_of_probability(p):
    return F.round(clip(p * 100, 0, 100), 2)


def risk_level_of_score(s):
    return (F.when(s <= 29.99, "Low").when(s <= 59.99, "Medium")
            .when(s <= 79.99, "High").when(s.isNotNull(), "Critical"))


def is_high_risk(name):
    return F.coalesce(F.lower(col(name).cast("string")).rlike("high|critical"), F.lit(False))


def logistic(score):
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clip(score, -50, 50)))


def money_text(x):
    return F.format_number(x, 2)


def exact(x, scale=6):
    """Decimal form, so that sums do not depend on the order of the rows."""
    return x.cast(T.DecimalType(28, scale))


def money_sum(x):
    return F.coalesce(F.sum(exact(x)), F.lit(0).cast(T.DecimalType(38, 6))).cast("double")


def percent(part, whole):
    """part / whole * 100 with two decimals; 0 when there is nothing to divide by."""
    ratio = part.cast("double") / whole.cast("double") * 100.0
    return F.round(F.when(whole > 0, ratio).otherwise(0.0), 2)


def mean_of(parts):
    """Mean of several columns of one row, skipping NULL."""
    parts = list(parts)
    total = reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in parts])
    seen = reduce(lambda a, b: a + b, [p.isNotNull().cast("int") for p in parts])
    return F.when(seen > 0, total / seen)


def weighted_mean(parts, weights):
    total = reduce(lambda a, b: a + b,
                   [F.coalesce(p, F.lit(0.0)) * F.lit(float(w)) for p, w in zip(parts, weights)])
    return total / F.lit(float(sum(weights)))


def band(x, bands):
    """Label of the first band whose inclusive upper edge is not below x."""
    expr = None
    for edge, name in bands:
        if edge is not None:
            hit = x <= edge
            expr = F.when(hit, name) if expr is None else expr.when(hit, name)
        else:
            expr = expr.when(x.isNotNull(), name)
    return expr


def long_form(df, columns, keys=(), name="feature", val="value"):
    """(keys, feature, value as text), one row per column. -0.0 is written as 0.0 so that
    equal numbers have one text."""
    def as_text(c):
        v = value(df, c)
        if isinstance(dtype(df, c), FLOATING):
            v = v + F.lit(0.0)
        return v.cast("string")
    pairs = F.array(*[F.struct(F.lit(c).alias(name), as_text(c).alias(val)) for c in columns])
    return df.select(*[col(k) for k in keys], F.inline(pairs))
