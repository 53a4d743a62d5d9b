"""File formats as DataFrames: bank statements, invoices, card bills and supplier ledgers."""
