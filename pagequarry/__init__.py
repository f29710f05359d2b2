"""Scholarly landing pages as Spark tables: extraction, evaluation and corpus analytics with DataFrames."""
