"""Palisade: governance analytics for LLM traffic, expressed as Spark plans."""
