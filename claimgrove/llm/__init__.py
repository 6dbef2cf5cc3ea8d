"""Training-data operators: screening, deduplication, tokenising, packing, sharding.

Nothing else in the library imports this package; `llm.queries` registers one
query per operator.
"""
