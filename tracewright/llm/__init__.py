"""Operators that prepare language-model training data, and their queries.

Nothing else in the library imports this subpackage.  `registry` gathers the
queries and their SQL; the entry module adds them when it can import it.
"""
