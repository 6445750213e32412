"""Operators that prepare training data for language models, one module each; nothing outside this folder imports them."""
