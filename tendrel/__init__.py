"""tendrel: evidence-coverage analytics and text-collection operators on Spark DataFrames."""
