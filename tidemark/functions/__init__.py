"""Column expressions: cleaning, ratios, transforms, labels and rolling frames."""
