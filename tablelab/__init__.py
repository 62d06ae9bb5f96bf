"""tablelab: a supervised-learning workbench for tables and text, built on Spark DataFrames.

A dataset is an ordinary DataFrame with two extra columns, ``_row_id`` (long) and ``split``
(``train`` / ``test`` / ``validation``), so every operator here can be mixed with plain Spark SQL.
"""

ROW_ID = "_row_id"
SPLIT = "split"
SPLITS = ("train", "test", "validation")

__all__ = ["ROW_ID", "SPLIT", "SPLITS"]
