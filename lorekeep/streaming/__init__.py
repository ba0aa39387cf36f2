"""The endless message loop as a stateless streaming query."""
