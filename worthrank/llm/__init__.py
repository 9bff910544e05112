"""Operators for building training corpora: packing, language identification, quality rules, source
mixing, nearest neighbours, toxicity, near-duplicate, substring and line de-duplication, and HTML
extraction. Nothing outside this subpackage imports it; ``queries.py`` registers one query each."""
