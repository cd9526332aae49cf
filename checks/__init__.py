"""Registered queries over the shared tables and the SQL that must give the same rows."""
