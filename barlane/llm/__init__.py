"""Operators that prepare training data for language models; nothing outside this package imports it."""
