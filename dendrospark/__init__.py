"""dendrospark: boosted-tree classifiers as exact decision graphs, on Spark DataFrames."""
