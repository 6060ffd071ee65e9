"""Layered, frame-synchronised analytics on Spark: exact time grids, layer grids, folds, validation, edits."""
