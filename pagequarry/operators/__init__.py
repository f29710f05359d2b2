"""DataFrame operators: DOM tables, extraction, evaluation, corpus analytics."""
