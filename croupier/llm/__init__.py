"""Training-data operators: language id, PII, quality, tokenisation, scoring and de-duplication.

Nothing outside this folder, ``corpus_pipeline.py`` and ``tests/llm`` depends on it.
"""
