"""Part of meshwork."""
