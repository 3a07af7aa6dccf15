"""Training-data operators. Nothing else in the package imports this subpackage.

Modules are imported on demand, so that one operator's dependencies never burden another.
"""
