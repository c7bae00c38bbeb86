"""Operators for preparing large text corpora; each module is one operator."""
