"""Training-data operators (language ID, near duplicates, mixing, PII, ...).

Nothing outside this subpackage imports it.  ``queries.QUERIES`` lists the
registered ``opN_<name>`` queries.
"""
