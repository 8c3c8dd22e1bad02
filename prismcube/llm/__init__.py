"""Operators that prepare text and tables for language-model training."""
