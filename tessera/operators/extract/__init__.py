"""Extraction of symbols, imports and calls from TypeScript and JavaScript sources, without Spark."""
