"""Feature selection, exact stratified splits and preprocessing for training."""

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.feature import (OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer,
                                VectorAssembler)
from pyspark.sql import functions as F

from ebbtide.functions import fixed
from ebbtide.functions.columns import (
    category_columns, col, is_text, label, long_form, numeric_columns, value)
from ebbtide.functions.names import plain
from ebbtide.operators.breakdown import distinct_levels, one_hot
from ebbtide.operators.clean import (
    apply_target, clean_text_columns, convert_numeric_columns, fill_values, fit_target)
from ebbtide.operators.rank import agg_values, order_statistics
from ebbtide.operators.roles import detect_columns

SEED = 42
TEST_SIZE = 0.20
LABEL = "__label"
KEY = "__key"
ROW_ID = "__row_id"
HIGH_CARDINALITY = 0.95


def useless_columns(df, target):
    """Empty, constant or index-like columns. Constant means smallest = largest and no gap, so
    no distinct count is needed."""
    names = [c for c in df.columns if c != target]
    exprs = {"n": F.count(F.lit(1))}
    for i, c in enumerate(names):
        v = value(df, c)
        exprs.update({f"c{i}": F.count(v), f"same{i}": F.min(v).eqNullSafe(F.max(v))})
    got = agg_values(df, exprs)
    return sorted(c for i, c in enumerate(names)
                  if got[f"c{i}"] == 0 or (got[f"same{i}"] and got[f"c{i}"] == got["n"])
                  or plain(c) in fixed.INDEX_COLUMNS)


def identifier_columns(columns, target):
    ident = detect_columns(columns)["customer_id"]
    return sorted({c for c in columns if c != target and
                   (c == ident or any(k in plain(c) for k in fixed.IDENTIFIER_KEYWORDS))})


def high_cardinality_columns(df, columns):
    """Text columns where more than 95% of the rows hold different values. A sketch (5%
    standard error) only spares columns that are ten deviations below; all others are counted."""
    texts = [c for c in columns if is_text(df, c)]
    if not texts:
        return []
    got = agg_values(df, {"n": F.count(F.lit(1)),
                          **{f"d{i}": F.approx_count_distinct(col(c)) for i, c in enumerate(texts)}})
    n = max(got["n"], 1)
    near = [c for i, c in enumerate(texts) if got[f"d{i}"] / n > HIGH_CARDINALITY * 0.5]
    if not near:
        return []
    exact = (long_form(df, near).where(F.col("value").isNotNull()).distinct()
             .groupBy("feature").count().collect())  # one row per column
    return [r["feature"] for r in exact if r["count"] / n > HIGH_CARDINALITY]


def select_features(df, target, include_identifiers=False):
    drop = set(useless_columns(df, target))
    if not include_identifiers:
        drop |= set(identifier_columns(df.columns, target))
    names = [c for c in df.columns if c != target and c not in drop]
    if not names:
        raise ValueError("no usable features")
    return names


def labelled_rows(df):
    """(rows with a readable 0/1 label in LABEL, target column) after typing of text columns."""
    typed = convert_numeric_columns(df)
    target = detect_columns(typed.columns)["churn"]
    if target is None:
        raise ValueError("no churn column found")
    rows = typed.withColumn(LABEL, label(typed, target).cast("int"))
    return rows.where(F.col(LABEL).isNotNull()), target


def processed_dataset(df):
    """Inspection table: one-hot text, median-filled numbers and the Churn label."""
    rows, target = labelled_rows(df)
    names = select_features(rows.drop(LABEL), target)
    rows = rows.select(*[col(c) for c in names], F.col(LABEL).alias("Churn"))
    texts = [c for c in category_columns(rows) if c != "Churn"]
    wide = one_hot(rows, texts, distinct_levels(rows, texts))
    numbers = [c for c in numeric_columns(rows) if c != "Churn"]
    medians, _ = fill_values(rows.select(*[col(c) for c in numbers])) if numbers else ({}, {})
    return wide.select(*[F.coalesce(value(wide, c), F.lit(medians[c])).alias(c) if c in medians else col(c)
                         for c in wide.columns])


# --- splits -----------------------------------------------------------------------------------------

def row_hash(columns, seed=SEED):
    return F.xxhash64(F.lit(seed), *[col(c) for c in columns])


def class_sizes(df, y=LABEL):
    return {r[0]: r[1] for r in df.groupBy(y).count().collect()}  # one row per class


def _hash_cuts(df, key, shares, seed, y):
    """{class: [hash value below or at which that share of the class lies]}: the exact order
    statistic, found without sorting a class in one task."""
    sizes = class_sizes(df, y)
    stratify = min(sizes.values()) >= 2
    groups = {c: F.col(y) == c for c in sizes} if stratify else {None: F.lit(True)}
    n = sizes if stratify else {None: sum(sizes.values())}
    names = {g: f"h{i}" for i, g in enumerate(groups)}
    h = df.select(*[F.when(cond, row_hash(key, seed)).alias(names[g]) for g, cond in groups.items()])
    ranks = {g: [round(s * n[g]) for s in shares] for g in groups}
    found = order_statistics(h, {names[g]: {k for k in ks if 0 < k <= n[g]} for g, ks in ranks.items()})
    return {g: [found[names[g]].get(k) for k in ks] for g, ks in ranks.items()}


def stratified_split(df, key, test_size=TEST_SIZE, seed=SEED, y=LABEL):
    """(train, test): the test side takes the exact share of every class. Membership depends on
    the hash of the key alone, so it is the same on every run; equal keys stay together."""
    cuts = _hash_cuts(df, key, [test_size], seed, y)

    def below(g):
        cut = cuts[g][0]
        return F.lit(False) if cut is None else row_hash(key, seed) <= F.lit(cut)
    if None in cuts:
        in_test = below(None)
    else:
        in_test = reduce(lambda a, b: a | b, [(F.col(y) == g) & below(g) for g in cuts])
    return df.where(~in_test), df.where(in_test)


def with_folds(df, key, folds, seed=SEED, y=LABEL, out="fold"):
    """Adds a fold number; every class is cut into folds of equal size along its hashes."""
    cuts = _hash_cuts(df, key, [j / folds for j in range(1, folds)], seed + 1, y)

    def fold(g):
        parts = [(row_hash(key, seed + 1) > F.lit(c)).cast("int") for c in cuts[g] if c is not None]
        return reduce(lambda a, b: a + b, parts, F.lit(0))
    if None in cuts:
        return df.withColumn(out, fold(None))
    expr = F.lit(0)
    for g in cuts:
        expr = F.when(F.col(y) == g, fold(g)).otherwise(expr)
    return df.withColumn(out, expr)


def prepare_training_data(df, key=None, test_size=TEST_SIZE, seed=SEED, include_identifiers=False):
    """(train, test, metadata). The key decides the split; without one the whole row does."""
    rows, target = labelled_rows(df)
    sizes = class_sizes(rows)
    if len(sizes) < 2:
        raise ValueError("the churn column must contain two classes")
    names = select_features(rows.drop(LABEL), target, include_identifiers)
    key = [key] if isinstance(key, str) else key or [c for c in rows.columns if c != LABEL]
    rows = rows.withColumn(KEY, F.struct(*[col(c) for c in key]))
    rows = rows.select(KEY, LABEL, *[col(c) for c in names])
    train, test = stratified_split(rows, [KEY], test_size, seed)
    metadata = {
        "target_column": target, "feature_columns": names,
        "numeric_features": [c for c in names if c in numeric_columns(rows)],
        "categorical_features": [c for c in names if c in category_columns(rows)],
        "identifier_columns": identifier_columns(df.columns, target),
        "total_rows": sum(sizes.values()),
        "class_distribution": {str(k): v for k, v in sorted(sizes.items())},
        "random_state": seed, "test_size": test_size}
    return train, test, metadata


# --- preprocessing ------------------------------------------------------------------------------

def class_weights(sizes):
    """Balanced weights n / (classes * n_class)."""
    n = sum(sizes.values())
    return {c: n / (len(sizes) * m) for c, m in sizes.items()}


def with_class_weight(df, sizes=None, y=LABEL, out="__weight"):
    expr = F.lit(1.0)
    for c, w in class_weights(sizes or class_sizes(df, y)).items():
        expr = F.when(F.col(y) == c, F.lit(w)).otherwise(expr)
    return df.withColumn(out, expr)


def _quoted(text):
    return "'" + str(text).replace("\\", "\\\\").replace("'", "\\'") + "'"


def build_preprocessor(train, numbers, texts):
    """Unfitted pipeline whose fill values come from the training rows: median and scaling for
    numbers, mode and one-hot for text. One-hot vectors are sparse, so the number of categories has no
    bound of its own. An unseen category becomes all zeros."""
    if not numbers and not texts:
        raise ValueError("no numeric or categorical features")
    medians, modes = fill_values(train.select(*[col(c) for c in numbers + texts]))
    fills = [f"CAST(coalesce(nanvl(CAST(`{c}` AS DOUBLE), NULL), {medians.get(c, 0.0)!r}D) AS DOUBLE) AS `__n_{i}`"
             for i, c in enumerate(numbers)]
    fills += [f"coalesce(CAST(`{c}` AS STRING), {_quoted(modes[c])}) AS `__c_{i}`" for i, c in enumerate(texts)]
    stages = [SQLTransformer(statement=f"SELECT *, {', '.join(fills)} FROM __THIS__")]
    parts = []
    if numbers:
        stages += [VectorAssembler(inputCols=[f"__n_{i}" for i in range(len(numbers))], outputCol="__numbers"),
                   StandardScaler(inputCol="__numbers", outputCol="__scaled", withMean=True, withStd=True)]
        parts.append("__scaled")
    if texts:
        index, hot = [f"__i_{i}" for i in range(len(texts))], [f"__h_{i}" for i in range(len(texts))]
        stages += [StringIndexer(inputCols=[f"__c_{i}" for i in range(len(texts))], outputCols=index,
                                 handleInvalid="keep", stringOrderType="alphabetAsc"),
                   OneHotEncoder(inputCols=index, outputCols=hot, dropLast=True)]
        parts += hot
    stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
    return Pipeline(stages=stages)


def fit_preprocessor(train, metadata):
    return build_preprocessor(train, metadata["numeric_features"], metadata["categorical_features"]).fit(train)


def feature_names(fitted, metadata):
    """Names of the assembled features, numbers first."""
    names = list(metadata["numeric_features"])
    for stage in fitted.stages:
        if hasattr(stage, "labelsArray"):
            for c, levels in zip(metadata["categorical_features"], stage.labelsArray):
                names += [f"{c}_{v}" for v in levels]
    return names


def adaptive_rows(df, target):
    """Rows and features for a model trained on a table's own labels: id and nearly unique text
    are dropped, the target is never a feature."""
    rows = clean_text_columns(df)
    rule = fit_target(rows, target)
    rows = rows.withColumn(LABEL, apply_target(rows, target, rule)).where(F.col(LABEL).isNotNull())
    return rows
