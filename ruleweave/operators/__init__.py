"""Working memory, rule firing and truth maintenance over DataFrames."""
