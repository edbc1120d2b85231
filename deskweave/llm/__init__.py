"""Operators for preparing large text collections, each a Spark job over whole tables."""
