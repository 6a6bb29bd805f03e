"""Operators for building language-model training corpora.

Self-contained: the rest of the library never imports this subpackage.
"""
