"""Ledgerline: data quality, address validation and company enrichment on Spark DataFrames."""
