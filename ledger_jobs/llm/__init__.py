"""Operations of a training-data pipeline, each a function from DataFrame to DataFrame.

Nothing outside this subpackage imports it.  ``queries.py`` binds the operators to the tables of
a data folder; every other module is one operator or a helper shared by several.
"""
