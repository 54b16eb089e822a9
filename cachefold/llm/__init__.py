"""Training-data operators: one module an operator, registered in :mod:`cachefold.llm.queries`.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
