"""Relational operators over pages, words, readings and documents."""
