"""Cleaning. Facts that depend on the data (types, fill values) are fitted once into a
`CleaningProfile`; applying a profile is one lazy projection and works on any later batch."""

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import functions as F

from ebbtide.functions import fixed
from ebbtide.functions.columns import (
    col, drop_null_tokens, is_number, is_text, label, long_form, lower_text,
    missing, number, numeric_columns, parse_number, value)
from ebbtide.functions.names import find_column
from ebbtide.operators.rank import agg_values, exact_quantiles
from ebbtide.operators.roles import detect_columns
from ebbtide.session import materialize

TYPING_RATIO = 0.90
SCORING_RATIO = 0.85
LABEL_RATIO = 0.90
TARGET_RATIO = 0.95
FORCED_ROLES = ("total_charges", "tenure", "monthly_charges")


@dataclass
class CleaningProfile:
    columns: list = field(default_factory=list)
    numeric: list = field(default_factory=list)
    churn: str | None = None
    medians: dict = field(default_factory=dict)
    modes: dict = field(default_factory=dict)

    def to_json(self):
        return json.dumps(asdict(self), ensure_ascii=False)

    @classmethod
    def from_json(cls, text):
        return cls(**json.loads(text))


def clean_column_names(df):
    """Trim names and collapse inner spaces; a repeated name gets a number so that it stays
    addressable."""
    seen, names = {}, []
    for c in df.columns:
        name = " ".join(c.split())
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}.{seen[name]}")
    return df.toDF(*names)


def drop_repeated_columns(df):
    """Keep the first of several columns with one name."""
    first = [i for i, c in enumerate(df.columns) if c not in df.columns[:i]]
    named = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return named.select(*[F.col(f"c{i}").alias(df.columns[i]) for i in first])


def not_missing_counts(df):
    got = agg_values(df, {f"n{i}": F.count(value(df, c)) for i, c in enumerate(df.columns)})
    return {c: got[f"n{i}"] for i, c in enumerate(df.columns)}


def drop_empty_rows(df):
    return df.where(F.coalesce(*[value(df, c).cast("string") for c in df.columns]).isNotNull())


def remove_empty_data(df):
    """Drop all-empty rows, then all-empty columns (one counting job decides which)."""
    rows = drop_empty_rows(df)
    counts = not_missing_counts(rows)
    return rows.select(*[col(c) for c in rows.columns if counts[c]])


def remove_duplicates(df):
    return df.dropDuplicates()


def clean_text_columns(df):
    return df.select(*[drop_null_tokens(col(c)).alias(c) if is_text(df, c) else col(c)
                       for c in df.columns])


def numeric_text_columns(df, ratio=TYPING_RATIO, currency=True, of_all_rows=False):
    """Text columns that mostly hold numbers: parsed / non-null (or all rows) >= ratio."""
    texts = [c for c in df.columns if is_text(df, c)]
    exprs = {"rows": F.count(F.lit(1))}
    for i, c in enumerate(texts):
        t = drop_null_tokens(col(c))
        exprs[f"t{i}"] = F.count(t)
        exprs[f"p{i}"] = F.count(parse_number(t, currency))
    got = agg_values(df, exprs)
    return [c for i, c in enumerate(texts)
            if got[f"t{i}"] and got[f"p{i}"] / (got["rows"] if of_all_rows else got[f"t{i}"]) >= ratio]


def to_numbers(df, columns, currency=True):
    return df.select(*[number(df, c, currency).alias(c) if c in columns else col(c)
                       for c in df.columns])


def convert_numeric_columns(df, ratio=TYPING_RATIO, currency=True, of_all_rows=False):
    return to_numbers(df, numeric_text_columns(df, ratio, currency, of_all_rows), currency)


def forced_numeric_columns(df):
    roles = detect_columns(df.columns)
    return [roles[r] for r in FORCED_ROLES if roles[r] and is_text(df, roles[r])]


def clean_common_columns(df):
    """Charges and tenure are numbers, whatever share of them can be read."""
    return to_numbers(df, forced_numeric_columns(df))


def column_modes(df, columns):
    """{column: most frequent text}, the smallest on a tie. Counts are combined per value
    before one small aggregate picks the best, so no task holds all values of a column."""
    if not columns:
        return {}
    counts = (long_form(df, columns).where(F.col("value").isNotNull())
              .groupBy("feature", "value").agg(F.count("*").alias("n")))
    best = counts.groupBy("feature").agg(
        F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("best"))
    return {r["feature"]: r["best"]["value"] for r in best.collect()}  # one row per column


def fill_values(df, only_gaps=False):
    """(medians, modes): the fill for numeric columns and for all others. `only_gaps` spares the
    modes of columns without a gap, above all the counting of every customer id."""
    numbers = numeric_columns(df)
    clean = df.select(*[value(df, c).cast("double").alias(c) for c in numbers]) if numbers else df
    medians = {c: q[0] for c, q in exact_quantiles(clean, numbers, [0.5]).items() if q[0] is not None}
    others = [c for c in df.columns if c not in numbers]
    if only_gaps and others:
        got = agg_values(df, {"n": F.count(F.lit(1)), **{f"c{i}": F.count(col(c)) for i, c in enumerate(others)}})
        others = [c for i, c in enumerate(others) if got[f"c{i}"] < got["n"]]
    return medians, {**dict.fromkeys(others, "Unknown"), **column_modes(df, others)}


def fill_missing(df, medians, modes):
    def filled(c):
        if c in medians:
            return F.coalesce(value(df, c), F.lit(medians[c])).alias(c)
        if c in modes and (is_text(df, c) or modes[c] != "Unknown"):
            return F.coalesce(col(c), F.lit(modes[c]).cast(df.schema[c].dataType)).alias(c)
        return col(c)
    return df.select(*[filled(c) for c in df.columns])


def handle_missing_values(df):
    return fill_missing(df, *fill_values(df, only_gaps=True))


def recognized_share(df, name):
    t, known = agg_values(df, {"t": F.count(value(df, name)), "k": F.count(label(df, name))}).values()
    return known / max(t, 1)


def clean_churn_target(df, name=None, strict=True):
    """Map the churn column to 1/0/NULL. Strict: only when at least 90% of it is recognized
    (numbers: only when nothing but 0 and 1 occurs)."""
    name = name or detect_columns(df.columns)["churn"]
    if name is None:
        return df
    need = 1.0 if is_number(df, name) else LABEL_RATIO
    if strict and recognized_share(df, name) < need:
        return df
    return df.withColumn(name, label(df, name).cast("int"))


def fit_target(df, name):
    """Rule (kind, low, high) that turns a target column into 0/1 from its own data."""
    reverse = find_column([name], fixed.REVERSED_TARGETS) is not None
    x = number(df, name)
    t = lower_text(name)
    t = F.when(~t.isin("nan", "none", ""), t)
    got = agg_values(df, {
        "rows": F.count(F.lit(1)), "numbers": F.count(x), "low": F.min(x), "high": F.max(x),
        "binary": F.count_if(x.isin(0.0, 1.0)), "words": F.count(label(df, name)),
        "first": F.min(t), "last": F.max(t)})

    def only_two(expr, low, high):
        other = df.agg(F.count_if((expr != F.lit(low)) & (expr != F.lit(high)))).first()[0]
        return low is not None and low != high and not other
    rule = ("words", None, None)
    if got["rows"] and got["numbers"] / got["rows"] >= TARGET_RATIO:
        if got["binary"] == got["numbers"]:
            rule = ("number", 0.0, 1.0)
        elif only_two(x, got["low"], got["high"]):
            rule = ("number", got["low"], got["high"])
    if rule[0] == "words" and not got["words"] and only_two(t, got["first"], got["last"]):
        rule = ("text", got["first"], got["last"])
    # The word lists already read "retained" as 0; only a 1/0 style column is turned round.
    return rule + (reverse,)


def apply_target(df, name, rule):
    """1 / 0 / NULL; what the rule does not know stays NULL."""
    kind, low, high, reverse = rule
    if kind == "words":
        y = label(df, name)
    else:
        x = number(df, name) if kind == "number" else lower_text(name)
        y = F.when(x == low, 0).when(x == high, 1)
    if reverse:
        t = lower_text(name)
        y = F.when(t.isin("retained", "retain", "not churned", "churned", "churn"), y).otherwise(1 - y)
    return y.cast("int")


def normalize_target(df, name):
    return df.withColumn(name, apply_target(df, name, fit_target(df, name)))


def light_clean(df):
    """Names, empty rows and columns, duplicates, null tokens and typing; no filling."""
    rows = materialize(clean_column_names(remove_empty_data(df)).dropDuplicates(), "distinct-rows")
    return convert_numeric_columns(clean_text_columns(rows))


def scoring_clean(df, dedupe=False):
    """Cleaning before scoring. Duplicates are kept unless asked for, so that every input row
    gets its score."""
    rows = drop_empty_rows(drop_repeated_columns(df))
    rows = clean_text_columns(materialize(rows.dropDuplicates(), "distinct-rows") if dedupe else rows)
    return convert_numeric_columns(rows, SCORING_RATIO, currency=False, of_all_rows=True)


def _typed(df, profile):
    out = clean_text_columns(df.select(*[col(c) for c in profile.columns]))
    out = to_numbers(out, profile.numeric)
    if profile.churn:
        out = out.withColumn(profile.churn, label(out, profile.churn).cast("int"))
    return out


def fit_cleaning(rows):
    """Profile of de-duplicated rows without empty ones."""
    profile = CleaningProfile()
    counts = not_missing_counts(rows)
    profile.columns = [c for c in rows.columns if counts[c]]
    kept = rows.select(*[col(c) for c in profile.columns])
    numeric = numeric_text_columns(kept)
    profile.numeric = [c for c in kept.columns if c in numeric + forced_numeric_columns(kept)]
    typed = _typed(kept, profile)
    churn = detect_columns(kept.columns)["churn"]
    if churn and recognized_share(typed, churn) >= (1.0 if is_number(typed, churn) else LABEL_RATIO):
        profile.churn = churn
        typed = _typed(kept, profile)
    profile.medians, profile.modes = fill_values(typed, only_gaps=True)
    if churn and profile.medians.get(churn) not in (None, 0.0, 1.0):
        del profile.medians[churn]  # a label is never filled with a half
    return profile


def apply_cleaning(df, profile):
    """Typing, labels and filling of a profile; no job, no shuffle."""
    out = fill_missing(_typed(df, profile), profile.medians, profile.modes)
    if profile.churn:
        out = out.withColumn(profile.churn, col(profile.churn).cast("int"))
    return out


def clean_dataset(df):
    """Full cleaning: (cleaned rows, report of one row, profile)."""
    named = clean_column_names(df)
    rows = materialize(drop_empty_rows(named).dropDuplicates(), "distinct-rows")
    profile = fit_cleaning(rows)
    cleaned = apply_cleaning(rows, profile)
    gaps_before = sum((missing(named, c).cast("long") for c in named.columns), F.lit(0).cast("long"))
    gaps_after = sum((missing(cleaned, c).cast("long") for c in cleaned.columns), F.lit(0).cast("long"))
    all_empty = F.coalesce(*[value(named, c).cast("string") for c in named.columns]).isNull()
    before = named.agg(
        F.count("*").alias("n"), F.count_if(all_empty).alias("empty"),
        F.coalesce(F.sum(gaps_before), F.lit(0)).alias("gaps")).first()
    report = cleaned.agg(
        F.lit(before["n"]).cast("long").alias("original_rows"),
        F.lit(len(df.columns)).cast("long").alias("original_columns"),
        F.count("*").alias("final_rows"),
        F.lit(len(cleaned.columns)).cast("long").alias("final_columns"),
        (F.lit(before["n"] - before["empty"]) - F.count("*")).cast("long").alias("duplicates_removed"),
        F.lit(before["gaps"]).cast("long").alias("missing_values_before"),
        F.coalesce(F.sum(gaps_after), F.lit(0)).cast("long").alias("missing_values_after"))
    return cleaned, report, profile
