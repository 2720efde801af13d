"""Whole analyses and the catalogue of checked queries."""
