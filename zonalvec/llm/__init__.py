"""Training-data operators: fingerprints, sharding, scans, classifiers, archives, packing.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
