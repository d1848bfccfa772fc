"""Operators for preparing training text: dedup, packing, scans, classifiers, search, fingerprints, archives."""
