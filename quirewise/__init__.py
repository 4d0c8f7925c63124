"""quirewise: auditing of document revisions at corpus scale, on Spark DataFrames."""
