"""Bitemporal context graphs as Spark DataFrames."""
