"""Operators for preparing language-model training data, and their queries.

Each module holds one operator under its own general interface; ``queries``
binds them to the driver tables.  Nothing outside this subpackage (apart from
the guarded hook in ``__spark_entry__.py`` and ``corpus_pipeline.py``) imports
it.
"""
