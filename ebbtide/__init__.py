"""Customer-churn analytics as Spark DataFrame transformations."""
