"""Training-data operators: deduplication, quality, language, packing, chat, tokens, HTML.

Nothing outside this subpackage imports it; ``queries.py`` holds the queries
and ``oracles.py`` the SQL that the entry module registers.
"""
