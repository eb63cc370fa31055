"""Semantics over trees: scopes and chains, cross-document references, revisions of attributes."""
