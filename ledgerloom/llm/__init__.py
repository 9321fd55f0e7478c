"""Operators that prepare a text corpus for language-model training.

Each module holds one operator; ``queries`` registers them. Nothing outside this
subpackage (and the repository's ``corpus_pipeline``) imports it.
"""
