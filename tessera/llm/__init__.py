"""Operators for building training corpora, each distributed over the documents it is given."""
