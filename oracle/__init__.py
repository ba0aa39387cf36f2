"""Check SQL for a second engine, one statement per query."""
