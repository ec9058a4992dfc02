"""Scriptorium: evidence-first corpus analytics as PySpark DataFrame operators."""
