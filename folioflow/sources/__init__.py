"""Readers: image folders, path lists, and page-shaped views of relational tables."""
