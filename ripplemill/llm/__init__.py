"""Operators for preparing large text corpora for model training.

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` imports it.
"""
