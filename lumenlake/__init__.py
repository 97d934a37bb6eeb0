"""lumenlake: media-catalog analytics on PySpark DataFrames."""
