"""Grounding evaluation of extracted labels as Spark DataFrame operators."""
