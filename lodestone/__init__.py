"""A Spark-native engine for tabular data quality.

Tables are DataFrames with a long ``_row`` column and string cells; every operator maps DataFrames
to DataFrames, and only policies, schemas and the journal live on the driver.
"""
