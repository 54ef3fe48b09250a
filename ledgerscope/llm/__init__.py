"""Operators of a training-data pipeline (packing, URL filters, chat formatting, quality rules,
near-duplicates, fingerprints, WARC, toxicity, source mixing, language identification).

Nothing else in the package imports this subpackage; its registered queries are in ``queries``.
"""
