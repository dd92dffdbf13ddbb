"""End-to-end compositions: the scoring run and the catalog of runnable queries."""
