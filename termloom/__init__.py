"""Document terminology, translation-QA and corpus operators on Spark DataFrames."""
