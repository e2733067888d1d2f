"""The relation plane: lists at the top of a query as DataFrames."""
