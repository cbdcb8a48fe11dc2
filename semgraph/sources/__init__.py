"""Where rows come from and where triples go."""
