"""Coloured sequence-graph analytics as Spark DataFrame transformations."""
