"""Readers: ZIP uploads, EPUB books, HTML pages."""
