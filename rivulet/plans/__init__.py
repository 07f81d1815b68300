"""Programs of tables and views."""
