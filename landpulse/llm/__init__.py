"""Operators for training-data pipelines over alert and report texts, archives and signatures."""
