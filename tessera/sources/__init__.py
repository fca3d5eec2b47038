"""Readers and writers of logs, pages and exports."""
