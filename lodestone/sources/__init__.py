"""Readers and writers: questions, descriptions, scripts, schemas, prompt dumps, model clients; reports and tables."""
