"""Operators for preparing training text: filters, deduplication, tokenisation, packing, archives.

Nothing outside this subpackage imports it; its registered queries are in ``queries``.
"""
