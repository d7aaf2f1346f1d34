"""Corpora: directories, lists of files, texts and tables."""
