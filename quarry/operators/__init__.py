"""Relational operators: lexical, vector, symbol and hybrid ranking."""
