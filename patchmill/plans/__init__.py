"""Queries: operators bound to the tables of a folder, with the SQL that must give the same rows."""

MODULES = ("files", "manifest", "metrics", "structure", "pixels", "streams")
