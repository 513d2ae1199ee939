"""Operators for preparing language-model training data, each from DataFrame to DataFrame."""
