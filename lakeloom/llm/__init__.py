"""Operators for building language-model training corpora.

Nothing outside this subpackage imports it: it can be deleted and the rest of
the library still works.  ``queries`` lists the registered queries.
"""
