"""Corpus-preparation operators for training data.

Nothing outside this subpackage imports it; its queries are registered by
``__spark_entry__.py`` only when it can be imported.
"""
