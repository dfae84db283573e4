"""DataFrame operators on artifacts, ledgers, graphs, searches, feedback and reports."""
