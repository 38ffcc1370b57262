"""Operations that prepare text corpora for language-model training.

Nothing outside this subpackage imports it.  Each operator lives in a module of
its own, takes and returns DataFrames and has the documented behaviour for nulls,
empty texts, repeated rows and empty tables.
"""
