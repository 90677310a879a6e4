"""Operators that prepare training corpora: filtering, deduplication, search, counting and mixing."""
