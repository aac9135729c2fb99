"""Training-data operators. Nothing outside this subpackage imports it.

Every operator takes and returns DataFrames. Numpy and Arrow run inside tasks only; Spark
partitions and shuffles the work. Intermediate tables go to the folder named by
``spark.checkpoint.dir`` (see :mod:`quill.llm.shared`).
"""
