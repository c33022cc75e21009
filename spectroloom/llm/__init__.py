"""Training-data preparation on Spark: formatting, scoring, deduplication and mixing of text corpora.

Nothing outside this subpackage imports it.
"""
