"""Where rows come from, and checks on them."""
