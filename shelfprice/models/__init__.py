"""Demand regressors, model-driven prices and customer segments on Spark ML."""
