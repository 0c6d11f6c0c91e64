"""Lumetra: image-densitometry analytics expressed as Spark DataFrame operators."""
