"""Where rows come from: the domain tables, raw positional rows and files."""
