"""Documents in and out."""
