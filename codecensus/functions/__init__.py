"""Column -> Column building blocks (path classifiers, string scalars, fixed dictionaries)."""
