"""Relational operators: search, fusion, chunking, page layout, catalogue changes, answers."""
