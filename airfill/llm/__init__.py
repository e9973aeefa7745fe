"""Operators for preparing language-model training text, each a Spark job over whole tables.

Nothing outside this folder, ``corpus_pipeline.py`` and ``tests/llm`` imports it.
"""
