"""Training-data operators (deduplication, filtering, tokens, models).

One module per operator; ``queries`` registers the thin ``opN_<name>``
queries. Nothing outside this subpackage imports it, apart from the guarded
import in ``__spark_entry__.py`` and ``corpus_pipeline.py``.
"""
