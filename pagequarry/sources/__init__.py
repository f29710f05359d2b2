"""Readers and writers for gold tables, queues, claims, ledgers and page stores."""
