"""Whole questions, made of the operators."""
