"""Registered queries: operators bound to the ledger tables, each with the SQL that gives the same rows."""
