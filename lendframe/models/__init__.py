"""Models fitted by Spark: MLlib learners and closed-form fits from one aggregate."""
