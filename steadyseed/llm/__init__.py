"""Operators for preparing training text: counting, filtering, deduplicating, mixing and encoding documents."""
