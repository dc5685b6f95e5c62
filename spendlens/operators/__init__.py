"""The dataflows over finance relations; every function takes DataFrames, an explicit `as_of`, and answers for all users at once."""
