"""Part of bibspark."""
