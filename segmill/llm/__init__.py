"""Training-data operators: dedup, decontamination, scanning, scoring, mixing and tokenised output.

Each module holds one operator.  ``queries`` holds the registered queries and
their SQL.  Nothing outside this subpackage imports it.
"""
