"""Training-data operators: ten corpus operators and the queries that apply them to whole tables.

Nothing outside this package imports it, and every operator module can be used on its own.
"""
