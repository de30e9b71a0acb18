"""Training-data operators (tokenising, dedup, search, PII, mixing, language, URLs, HTML).

Nothing outside this subpackage imports it.  Each operator has a module of its
own; :mod:`tellgrid.llm.queries` holds the registered queries and their SQL.
"""
