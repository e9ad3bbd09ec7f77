"""Operators of a training-data pipeline (scoring, de-duplication, decontamination, packing, sharding).

Nothing else in the library imports this subpackage; it may be deleted.
"""
