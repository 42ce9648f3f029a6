"""Report plans: P&L, cashflow, expense report, statements, and the
registered query catalog."""
