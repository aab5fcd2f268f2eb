"""Operators for text that is to train language models.  Nothing outside this subpackage imports it."""
