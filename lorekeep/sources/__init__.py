"""Where rows come from and where shared tables are kept."""
