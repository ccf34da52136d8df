"""Operators that prepare conversation text for language models. Nothing else in the library imports this part."""
