"""Volumetric and object analytics expressed as Spark DataFrame operators."""
