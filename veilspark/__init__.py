"""Finds and masks personal information in text and tables, as Spark DataFrame expressions."""
