"""Timeline operators over DataFrames."""
