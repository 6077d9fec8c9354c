"""Labelled network-flow analytics expressed as Spark DataFrame operators."""
