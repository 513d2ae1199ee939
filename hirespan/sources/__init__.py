"""Readers for raw postings and tables, and writers for exports."""
