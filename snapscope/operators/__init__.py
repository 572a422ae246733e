"""DataFrame operators: diff, signals, profiles, text search, tracking, validation, browsing."""
