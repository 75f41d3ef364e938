"""Operations of a training-data pipeline over Spark DataFrames.

Nothing else in the package imports this subpackage.
"""
