"""Operators for language-model data and algorithms; nothing else in the library imports this."""
