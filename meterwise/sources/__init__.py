"""Sources and sinks: driver tables, raw invocation logs, ledger, sinks."""
