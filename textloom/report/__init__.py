"""Rendered output: pretty printing, error messages, annotated snippets."""
