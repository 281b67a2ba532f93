"""Training-data operators: licences, packing, WARC, toxicity, quality rules,
language-model scoring, token counts, near and exact duplicates, mixing,
Merkle manifests, periodic runs, page text.

Nothing outside this folder imports it, except the guarded registration in
``__spark_entry__.py`` and ``corpus_pipeline.py``.
"""
