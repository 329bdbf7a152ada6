"""Whole tables and jobs built from the operators."""
