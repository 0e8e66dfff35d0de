"""Incremental maintenance of the search tables (an extension: batch results are the same)."""
