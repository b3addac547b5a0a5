"""Versioned attribute data on Spark: entities with small typed field maps, as folds over DataFrames."""
