"""Corpus operators for large text collections; nothing outside this folder imports them."""
