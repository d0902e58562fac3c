"""Training-data operators: token counts, language, toxicity, mixing, fingerprints,
sharding, exact and near duplicates, packing and secrets.

Nothing outside this subpackage imports it.
"""
