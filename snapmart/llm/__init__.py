"""Training-data operators: scoring, deduplication, packing, personal data, tokens.

Each module holds one operator with its general interface; ``queries`` applies
them to the given tables. Nothing outside this sub-package imports it.
"""
