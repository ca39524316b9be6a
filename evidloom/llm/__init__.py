"""Operators on free text and corpora for training data. Nothing outside this subpackage imports it."""
