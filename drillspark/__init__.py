"""Drill-down analytics on Spark DataFrames: facets, rollups, routes, search, series and metric mapping."""
