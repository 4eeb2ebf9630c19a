"""Operators for preparing text for language-model training, and their check queries."""
