"""Operations that a large training-text pipeline needs, as Spark jobs.

Nothing else in the library imports this subpackage. Each module holds one
operator with a general interface; ``queries`` registers one query per operator.
"""
