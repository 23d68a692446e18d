"""Training-data operators: ten self-contained modules, their queries in ``queries.py``."""
