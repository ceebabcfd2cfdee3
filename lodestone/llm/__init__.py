"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it.  Every operator takes DataFrames,
reads each text whole and writes its intermediate tables to the folder that
the cluster shares (``spark.checkpoint.dir``).
"""
