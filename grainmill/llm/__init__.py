"""Training-data pipeline operators: quality, toxicity, language, dedup, tokens, packing, fingerprints, search.

Nothing else in the library imports this subpackage.
"""
