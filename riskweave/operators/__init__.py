"""Operators: DataFrame(s) + parameters -> DataFrame. Nothing here collects rows to the driver."""
