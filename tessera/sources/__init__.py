"""Where rows come from and are kept: catalog, snapshot store, SQL text."""
