"""Operators for preparing large text corpora for training.

Nothing outside this subpackage imports it.  Each ``opN_*`` module holds one
operator with a general interface plus the thin query that derives digest
columns from it; ``registry`` collects the queries and their SQL.
"""
