"""Estimators with parameters over DataFrames."""
