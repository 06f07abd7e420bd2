"""Part of the cadastra package."""
