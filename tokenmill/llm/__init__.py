"""Training-data operators: packing, classifiers, rules, joins, scans, formatting.

Nothing else in the library imports this subpackage.
"""
