"""Declarative query plans: each is one SQL text, in Spark's words or in the words of an independent engine for checking."""
