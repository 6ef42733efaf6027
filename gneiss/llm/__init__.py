"""Operators for preparing language-model training text; nothing outside this subpackage imports it."""
