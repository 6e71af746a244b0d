"""Operations for building language-model training corpora, as Spark jobs.

Nothing outside this subpackage imports it.
"""
