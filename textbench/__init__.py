"""textbench: delimited files, SQL dumps, logs and text columns as Spark DataFrames."""
