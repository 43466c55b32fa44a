"""Training-data operators: packing, deduplication, decontamination, filtering and counting.

Every operator is a function from DataFrames to a DataFrame. Nothing else in the library imports this subpackage.
"""
