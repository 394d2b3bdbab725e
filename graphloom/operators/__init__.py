"""The algebra's operators on DataFrames."""
