"""A changelog-materialisation engine on PySpark: folds, streams, artifacts."""
