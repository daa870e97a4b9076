"""skylode: full-text search, column analytics and lifecycle management on plain Spark DataFrames."""
