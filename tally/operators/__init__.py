"""Ledger operators: cleaning, categories, sync, filters, periods, breakdowns."""
