"""Training-data operators: deduplication, archives, extraction, classifiers, tokens, decontamination.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
