"""strandwork: life-science analytics and corpus operators on Spark DataFrames."""
