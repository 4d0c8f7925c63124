"""Readers: parquet tables, Word packages, Markdown and text reports, YAML request files."""
