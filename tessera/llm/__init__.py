"""Operators of a training-data pipeline: mixing, near duplicates, varied subsets, broken pairs,
proportional samples, score fusion, corpus encoding, evaluation leaks and subject areas."""
