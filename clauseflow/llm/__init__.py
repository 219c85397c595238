"""Training-data operators: everything in this subpackage works on `documents`, `pages` and `benchmark` shaped tables.

Nothing outside this subpackage imports it; `catalog.py` lists its queries and their SQL.
"""
