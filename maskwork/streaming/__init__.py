"""Streams of documents and of conversation turns."""
