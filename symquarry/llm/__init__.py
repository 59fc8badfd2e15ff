"""Training-data operators: mixing, search, filtering, deduplication, sharding and archives.

Nothing outside this folder (but for ``corpus_pipeline.py`` and the guarded import in
``__spark_entry__.py``) depends on it.
"""
