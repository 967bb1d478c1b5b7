"""Tidemark: tables that live in a small hot tier and a large cold tier, as one Spark view."""
