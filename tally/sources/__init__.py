"""Sources and sinks: star-schema tables, raw ledger exports, versioned
ledger snapshots, and the derived test ledgers."""
