"""Operators for training-data pipelines: text, web pages, tokens and archives."""
