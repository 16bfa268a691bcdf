"""Search, filters, sorting and lookups on a customer or result table."""

from functools import reduce

from pyspark.sql import functions as F

from ebbtide.functions.columns import col, is_high_risk, is_text, number, percent
from ebbtide.functions.names import find_column, role


def apply_filters(df, filters):
    """Equality filters by role name, compared as text; None, "All" and unknown columns are
    ignored."""
    for wanted, selected in (filters or {}).items():
        name = find_column(df.columns, [wanted])
        if name is None or selected is None or (isinstance(selected, str) and selected == "All"):
            continue
        many = selected if isinstance(selected, (list, tuple, set)) else [selected]
        df = df.where(col(name).cast("string").isin([str(s) for s in many]))
    return df


def _all(flags):
    return reduce(lambda a, b: a & b, flags) if flags else F.lit(True)


def match_flag(df, phrase=None, choices=None, ranges=None):
    """Row predicate of the explorer: literal phrase in any column (ignoring case), chosen
    values by role, inclusive ranges by role (NULL fails)."""
    flags = []
    phrase = (phrase or "").strip()
    if phrase:
        hits = [F.coalesce(F.contains(F.lower(col(c).cast("string")), F.lower(F.lit(phrase))),
                           F.lit(False)) for c in df.columns]
        flags.append(reduce(lambda a, b: a | b, hits))
    for name, values in (choices or {}).items():
        c = role(df.columns, name)
        if c and values:
            flags.append(col(c).cast("string").isin([str(v) for v in values]))
    for name, bounds in (ranges or {}).items():
        c = role(df.columns, name)
        if c and bounds:
            flags.append(number(df, c).between(float(bounds[0]), float(bounds[1])))
    return _all(flags)


def explore(df, phrase=None, choices=None, ranges=None):
    """The explorer query: search(phrase) and choices and ranges."""
    return df.where(match_flag(df, phrase, choices, ranges))


def search(df, phrase):
    return explore(df, phrase=phrase)


def select_any(df, **choices):
    """select_any(df, risk_level=["High"], contract=["One year"])"""
    return explore(df, choices=choices)


def select_ranges(df, **ranges):
    """select_ranges(df, probability=(40, 80))"""
    return explore(df, ranges=ranges)


def filter_choices(df, roles=("risk_level", "predicted", "contract", "priority")):
    """(field, choice): sorted distinct values of each filter column, in one aggregation."""
    found = [(r, role(df.columns, r)) for r in roles]
    pairs = F.array(*[F.struct(F.lit(r).alias("field"), col(c).cast("string").alias("choice"))
                      for r, c in found if c])
    return (df.select(F.inline(pairs)).where(F.col("choice").isNotNull()).distinct()
            .orderBy("field", "choice"))


def filter_bounds(df, roles=("probability", "risk_score", "monthly_charges")):
    """(field, low, high) of each slider; probability stays within 0..100."""
    found = [(r, role(df.columns, r)) for r in roles]
    found = [(r, c) for r, c in found if c]
    one = df.agg(*[f(number(df, c)).alias(f"{k}_{r}") for r, c in found
                   for k, f in (("low", F.min), ("high", F.max))])

    def bound(r, k):
        x = F.col(f"{k}_{r}")
        if r == "probability":
            x = F.when(x < 0, F.lit(0.0)).when(x > 100, F.lit(100.0)).otherwise(x)
        return x.alias(k)
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(r).alias("field"), bound(r, "low"), bound(r, "high")) for r, _ in found])))


def explorer_summary(df, phrase=None, choices=None, ranges=None):
    """Totals, matches, match rate and high-risk matches in one scan: the explorer filters are
    row predicates, so a match is a flag rather than a second pass."""
    risk = role(df.columns, "risk_level")
    hit = match_flag(df, phrase, choices, ranges)
    return df.agg(
        F.count("*").alias("total"), F.count_if(hit).alias("matched"),
        F.count_if(hit & (is_high_risk(risk) if risk else F.lit(False))).alias("high_risk")).select(
        "total", "matched", percent(F.col("matched"), F.col("total")).alias("match_rate"), "high_risk")


def high_risk_customers(df, threshold=60, limit=None, tie_break=None):
    """Customers with a risk score of at least the threshold, highest first."""
    score = role(df.columns, "risk_score")
    if score is None:
        raise ValueError("no risk score column")
    order = [number(df, score).desc()] + ([col(tie_break)] if tie_break else [])
    out = df.where(number(df, score) >= threshold).orderBy(*order)
    return out.limit(limit) if limit else out


def sort_customers(df, ascending=False, limit=500):
    """By score, else probability, else id; as numbers when any value is one; NULL last."""
    name = next((c for c in (role(df.columns, r) for r in ("risk_score", "probability", "customer_id"))
                 if c), None)
    if name is None:
        return df.limit(limit)
    as_number = not is_text(df, name) or df.agg(F.count(number(df, name))).first()[0] > 0
    key = number(df, name) if as_number else col(name)
    ident = role(df.columns, "customer_id")
    order = [key.asc_nulls_last() if ascending else key.desc_nulls_last()]
    return df.orderBy(*order, *([col(ident)] if ident else [])).limit(limit)


def preview(df, n, *order):
    return df.orderBy(*[col(o) for o in order]).limit(n) if order else df.limit(n)


def customer_profile(df, customer, columns=None):
    """(attribute, value) of the customers with that id, over the columns that exist."""
    ident = role(df.columns, "customer_id")
    names = [role(df.columns, r) for r in (
        "customer_id", "contract", "tenure", "monthly_charges", "predicted", "probability",
        "risk_level", "risk_score", "priority")]
    names = columns or list(dict.fromkeys(n for n in names if n))
    pairs = F.array(*[F.struct(F.lit(c).alias("attribute"), col(c).cast("string").alias("value"))
                      for c in names])
    return df.where(col(ident).cast("string") == str(customer)).select(F.inline(pairs))


def existing(df, names):
    """Those of the named columns that exist, without repeats."""
    hits = [find_column(df.columns, [n]) for n in names if n]
    return df.select(*[col(c) for c in dict.fromkeys(h for h in hits if h)])


def high_risk_report(df, threshold=50):
    """Customers of high or critical level, or by score where no level exists."""
    risk, score = role(df.columns, "risk_level"), role(df.columns, "risk_score")
    if risk:
        df = df.where(is_high_risk(risk))
    elif score:
        df = df.where(number(df, score) >= threshold)
    return existing(df, [role(df.columns, r) for r in (
        "customer_id", "risk_level", "risk_score", "predicted", "probability", "monthly_charges")])


def retention_report(df):
    return existing(df, [role(df.columns, r) for r in (
        "customer_id", "priority", "risk_level", "risk_score", "probability", "recommendation",
        "action", "monthly_charges")])
