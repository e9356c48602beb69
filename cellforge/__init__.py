"""Turns collections of raw HTML documents into relational numeric records on Spark."""
