"""Multimodal analytics on Spark DataFrames: relational, spatial, text and vector queries."""
