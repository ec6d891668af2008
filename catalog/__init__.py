"""The library's queries on the test tables, and their plain SQL counterparts."""
