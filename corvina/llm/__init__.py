"""Training-data operators: ten corpus-scale operators and their registered queries.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its queries
only where it can be imported.
"""
