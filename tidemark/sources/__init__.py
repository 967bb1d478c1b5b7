"""Where rows come from: database, files, change feed, lake tables."""
