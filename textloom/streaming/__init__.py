"""Incremental maintenance: edit folding, change feeds, streams, revisions."""
