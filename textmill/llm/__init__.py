"""Operators for preparing training corpora; see the README for each one's contract."""
