"""Incremental intake of new pages."""
