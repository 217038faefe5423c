"""Operators for building training data out of a large corpus.

Nothing outside this subpackage imports it. Each module holds one operator with
its general interface; ``queries`` derives the registered queries from them.
"""
