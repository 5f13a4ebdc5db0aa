"""Operators of a large training-data pipeline: dedup, tokens, classifiers, rules, shards and mixes.

Each module holds one operator with its own interface; ``registry`` turns the operators into the
``opN_*`` queries. Nothing outside this folder imports it.
"""
