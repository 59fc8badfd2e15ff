"""Symbol extraction: one extractor per language, and the table function over file contents."""
