"""Grammars that accept or reject a text as a program or document of a language."""
