"""Light-curve datasets on Spark: sources, schema and label normalization, matching, curve features, evaluation."""
