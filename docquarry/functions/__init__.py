"""Column functions on JSON text and VARIANT values."""
