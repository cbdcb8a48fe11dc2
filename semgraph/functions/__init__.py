"""Column-level helpers: terms, templates and the scratch tables of iterative jobs."""
