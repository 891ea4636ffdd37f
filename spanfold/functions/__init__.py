"""Tokenizers, dictionaries and text configurations."""
