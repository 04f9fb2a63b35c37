"""geoweft: close-range sensing analytics as Spark DataFrames."""
