"""Files in and out. CSV columns are read as text; cleaning decides which are numbers."""

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ebbtide.functions.columns import col

def read_dataset(spark, path, encoding=None, multiline=False):
    """Read a CSV file or folder with a header. Without a given encoding the text is read as
    UTF-8; if one job finds a line whose bytes are not UTF-8, the file is read as ISO-8859-1, which
    accepts any byte. `multiline` allows line breaks inside quotes but keeps files from being split."""
    path = str(path)
    kind = path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)
    if len(kind) == 2 and kind[1].lower() in ("xls", "xlsx"):
        raise ValueError("convert Excel workbooks to CSV or Parquet first")
    if len(kind) == 2 and kind[1].lower() == "parquet":
        return _existing(lambda: spark.read.parquet(path), path)
    if len(kind) == 2 and kind[1].lower() not in ("csv", "gz", "bz2"):
        raise ValueError(f"unsupported file format: {path}")

    def read(enc):
        return _existing(lambda: spark.read.csv(path, header=True, encoding=enc, multiLine=multiline,
                                                escape='"', inferSchema=False), path)
    if encoding:
        return read(encoding)
    lines = _existing(lambda: spark.read.text(path), path)
    odd = lines.where(~F.is_valid_utf8(F.col("value").cast("binary").cast("string")))
    return read("UTF-8" if odd.isEmpty() else "ISO-8859-1")


def _existing(read, path):
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"dataset not found: {path}") from error
        raise


def first_dataset(spark, paths):
    """(data, path) of the first path that holds any row; (None, None) if none does."""
    for path in paths:
        try:
            df = read_dataset(spark, path)
        except (FileNotFoundError, ValueError):
            continue
        if df.columns and not df.isEmpty():
            return df, str(path)
    return None, None


def model_results(spark, paths):
    """The model-metrics table from the first usable path."""
    return first_dataset(spark, paths)[0]


def write_csv(df, path, mode="overwrite"):
    """CSV folder with one file per partition, each with a header; nothing is funnelled through
    one task. Arrays and maps have no CSV form and are written as JSON text."""
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
    out = df.select(*[F.to_json(col(c)).alias(c) if c in nested else col(c) for c in df.columns])
    out.write.csv(str(path), header=True, mode=mode, escape='"')
    return str(path)


# fixed values: titles of the published result columns
TITLES = {
    "churn_prediction": "Churn Prediction", "churn_probability": "Churn Probability",
    "risk_score": "Risk Score", "risk_level": "Risk Level", "prediction_method": "Prediction Method",
    "customer_risk_score": "Customer Risk Score", "customer_value": "Customer Value",
    "strategic_segment": "Strategic Segment", "retention_priority": "Retention Priority",
    "priority_rank": "Priority Rank", "revenue_at_risk": "Revenue At Risk",
    "recommended_action": "Recommended Action", "retention_recommendation": "Retention Recommendation",
    "retention_urgency_score": "Retention Urgency Score", "recommended_channel": "Recommended Channel",
}


def with_titles(df):
    """Result columns under their published titles, for reports."""
    return df.withColumnsRenamed({c: t for c, t in TITLES.items() if c in df.columns})


def clean_file(spark, source, target):
    """Read, clean and write a dataset; returns (cleaned, one-row report)."""
    from ebbtide.operators.clean import clean_dataset
    cleaned, report, _ = clean_dataset(read_dataset(spark, source))
    write_csv(cleaned, target)
    return cleaned, report
