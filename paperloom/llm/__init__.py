"""Operations of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage.  Each module holds one
operator with a general interface, and a thin query that applies it to the
whole of its table with production parameters.
"""
