"""Readers: fielded collections, page trees, topics, judgments, stop words."""
