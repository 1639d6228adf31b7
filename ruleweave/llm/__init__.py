"""Training-data operators: sharding, secrets, tokens, duplicates, packing, toxicity, neighbours.

Nothing outside this package imports it.  ``ruleweave.llm.registry`` lists its queries and their SQL.
"""
