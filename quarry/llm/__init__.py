"""Training-data operators: token counts, language identification, chat
formatting, similarity joins, sharding, mixing, substring and embedding
de-duplication, fingerprints and BPE coding.

Nothing else in the library imports this subpackage.
"""
