"""Scalar functions: languages, text, hashing, features."""
