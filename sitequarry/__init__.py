"""Spark-native analytics over engineering documents, drawings and project schedules.

Every operator is a plain function from DataFrames to a DataFrame. ``sitequarry.plans.catalogue`` names
them as runnable queries over a folder of Parquet tables.
"""
