"""Training-data operators: near and exact deduplication, tokens, packing, language and quality models.

Nothing else in the package imports this folder.
"""
