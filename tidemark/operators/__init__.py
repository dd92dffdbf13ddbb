"""The engine's operators, each a function from DataFrame to DataFrame."""
