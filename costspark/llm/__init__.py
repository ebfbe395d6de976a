"""Operations of a training-data pipeline, each one function from DataFrames to a DataFrame.

Shared rules: a null text counts as empty, further columns of the input are not
looked at, and an empty table gives an empty result.  A step that would keep a
long lineage writes a table to the shared folder and reads it back.
"""
