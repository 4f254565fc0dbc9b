"""Detection, evaluation and splitting operators on DataFrames."""
