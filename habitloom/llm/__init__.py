"""Operators for preparing training corpora at scale; nothing outside this folder imports them."""
