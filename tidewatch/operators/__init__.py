"""Relational operators on report and fact tables: DataFrame in, DataFrame out."""
