"""Where facts come from and where results go."""
