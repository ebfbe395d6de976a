"""Analytic operators: ``(DataFrame, ..., params) -> DataFrame``."""
